"""Pitch change: what is measured afterwards, length, and signals that stay."""

import numpy as np
import pytest

from speechmill.operators import pitch, spectral


def test_a_tone_of_200_hertz_becomes_one_of_250(spark):
    t = np.arange(12_000) / 16_000
    rows = spark.createDataFrame([(1, np.sin(2 * np.pi * 200 * t).tolist()), (2, np.sin(2 * np.pi * 200 * t).tolist()), (3, [0.5, 0.25]), (4, [])], "vec_id long, x array<double>")
    ratios = spark.createDataFrame([(1, 1.25), (2, 0.8), (3, 1.0), (4, 2.0)], "vec_id long, ratio double")
    got = {r.vec_id: np.array(r.y) for r in pitch.shifted(rows, ratios).collect()}
    assert [len(got[k]) for k in (1, 2, 3, 4)] == [12_000, 12_000, 2, 0] and got[3].tolist() == [0.5, 0.25]
    for k, want in ((1, 250), (2, 160)):
        f0 = spectral.pitch(got[k])
        assert np.median(f0[4:-4]) == pytest.approx(want, rel=0.01)
        assert 0.8 < np.abs(got[k][2000:-2000]).max() < 1.2


def test_a_stretch_by_one_gives_the_signal_back(spark):
    x = np.random.default_rng(1).normal(size=5000)
    rows = spark.createDataFrame([(1, x.tolist())], "vec_id long, x array<double>")
    back = pitch.samples(pitch.stretched_bins(pitch.bins(rows), spark.createDataFrame([(1, 1.0)], "vec_id long, ratio double"))).where("i < 4600").orderBy("i").toPandas()
    assert np.abs(back.v.to_numpy() - x[:4600]).max() < 1e-9


def test_ratio_of_voiced_medians(spark):
    a = spark.createDataFrame([(1, 0.0), (1, 200.0), (1, 220.0), (1, 240.0), (2, 100.0)], "vec_id long, f0 double")
    b = spark.createDataFrame([(1, 110.0), (1, 0.0), (2, 0.0)], "vec_id long, f0 double")
    assert [tuple(r) for r in pitch.ratios_of(a, b).collect()] == [(1, 2.0)]


def test_short_signals_are_shifted_as_by_rows_and_write_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [(1, 5000, 1.25), (2, 3000, 0.8), (3, 700, 1.5), (4, 100, 0.7), (5, 2000, None)]
    rows = spark.createDataFrame([(k, rng.normal(size=n).tolist(), r) for k, n, r in sizes] + [(6, None, 1.25)], "vec_id long, x array<double>, ratio double")
    by_rows = {r.vec_id: r.y for r in pitch._shifted_by_rows(rows.where("vec_id < 5")).collect()}
    seen = []
    write = pitch.written
    monkeypatch.setattr(pitch, "written", lambda df, name: seen.append(df.count()) or write(df, name))
    got = {r.vec_id: r.y for r in pitch.shifted(rows).collect()}
    assert sum(seen) == 0 and got[6] is None and len(got[5]) == 2000
    for k in by_rows:
        assert got[k] == pytest.approx(by_rows[k], abs=1e-8)
    # longer ones go by rows, with the same result
    monkeypatch.setattr(pitch, "LONG", 1000)
    cut = {r.vec_id: r.y for r in pitch.shifted(rows).collect()}
    assert sum(seen) > 0 and all(cut[k] == pytest.approx(got[k], abs=1e-8) for k in by_rows)
