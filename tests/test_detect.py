"""Training by epochs against numpy, and going on after a loss."""

import shutil

import numpy as np
import pytest

from pyspark.sql import functions as F

from speechmill.operators import detect


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    made = [(i, (rng.normal(size=3) + (i % 2) * np.array([1.0, -0.5, 0.0])).tolist() + [4.0], i % 2, "val" if i % 5 == 0 else "train") for i in range(200)]
    return detect.standardised(spark.createDataFrame(made, "vec_id long, pooled array<double>, label int, part string"))


def _plain(rows, epochs, batches, rate=1.0, penalty=detect.PENALTY):
    data = rows.collect()
    deal = {e: {r.vec_id: r.b for r in rows.select("vec_id", F.pmod(F.xxhash64("vec_id", F.lit(e)), F.lit(batches)).alias("b")).collect()} for e in range(epochs)}
    w, b, out = np.zeros(4), 0.0, []
    train, val = [r for r in data if r.part == "train"], [r for r in data if r.part == "val"]
    p = lambda rs: 1 / (1 + np.exp(-(np.array([r.pooled for r in rs]) @ w + b)))
    loss = lambda rs: -np.mean([np.log(q if r.label else 1 - q) for r, q in zip(rs, p(rs))])
    for e in range(epochs):
        for k in range(batches):
            own = [r for r in train if batches == 1 or deal[e][r.vec_id] == k]
            gap = p(own) - np.array([r.label for r in own])
            w, b = w - rate * (np.mean(gap[:, None] * np.array([r.pooled for r in own]), axis=0) + penalty * w), b - rate * gap.mean()
        out.append((w, b, loss(train), loss(val)))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_epochs_against_numpy(rows, tmp_path, batches):
    got = detect.fit_epochs(rows, f"{tmp_path}/a", 3, batches)
    for r, (w, b, train, val) in zip(got, _plain(rows, 3, batches), strict=True):
        assert r.weights == pytest.approx(w.tolist()) and r.bias == pytest.approx(b) and r.train_loss == pytest.approx(train) and r.val_loss == pytest.approx(val)
        assert 0 <= r.val_eer <= 1 and 0 <= r.val_accuracy <= 1
    assert got[-1].train_loss < got[0].train_loss and got[0].weights[3] == pytest.approx(0)  # a constant column is centred


def test_a_run_goes_on_after_the_last_whole_epoch(spark, rows, tmp_path):
    whole = detect.fit_epochs(rows, f"{tmp_path}/whole", 3, 2)
    detect.fit_epochs(rows, f"{tmp_path}/part", 2, 2)
    shutil.rmtree(f"{tmp_path}/part/epoch-1")  # lost while it was written
    again = detect.fit_epochs(rows, f"{tmp_path}/part", 3, 2)
    assert again[-1].weights == pytest.approx(whole[-1].weights) and [r.epoch for r in again] == [0, 1, 2]
    assert detect.history(spark, f"{tmp_path}/part", 9).count() == 3
