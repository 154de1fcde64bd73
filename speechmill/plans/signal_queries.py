"""Queries of the functions on signals: normalising, slicing, framing, gain and noise."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import signal as S
from ..operators import pitch, scoring, spectral
from . import spectral_sql as Z
from .registry import FRAMES, SIGNALS, frames, query, rounded, signals, table


def _long(name: str, make, sql: str, where: str = "") -> None:
    """A query that gives a new signal for each one, a row for each sample."""
    text = f"WITH {SIGNALS} SELECT vec_id, CAST(unnest(range(len(y))) AS INTEGER) AS i, round(unnest(y), 6) + 0.0::DOUBLE AS y FROM (SELECT vec_id, {sql} AS y FROM s)"

    @query(name, text)
    def run(spark, sf_dir):
        return signals(spark, sf_dir).select("vec_id", F.posexplode(make(F.col("x"))).alias("i", "y")).select("vec_id", "i", rounded("y").alias("y"))


def _one(name: str, make, sql: str) -> None:
    """A query that gives one value for each signal."""

    @query(name, f"WITH {SIGNALS} SELECT vec_id, round({sql}, 6) + 0.0::DOUBLE AS y FROM s")
    def run(spark, sf_dir):
        return signals(spark, sf_dir).select("vec_id", rounded(make(F.col("x"))).alias("y"))


_unit = "list_transform(x, lambda v: greatest(-1::DOUBLE, least(1::DOUBLE, v * pow(10::DOUBLE, (-23 - 20 * log10({} + 1e-9::DOUBLE)) / 20))))"
_long("p1_rms_normalise", S.rms_normalised, _unit.format("sqrt(e / n)"))
_long("p2_peak_normalise_dbfs", S.peak_normalised_dbfs, _unit.format("p"))
_long("p3_peak_normalise", S.peak_normalised, "CASE WHEN p > 0 THEN list_transform(x, lambda v: v / p * 0.9::DOUBLE) ELSE x END")
_long("p4_mono_mix", lambda x: S.mono(F.array(F.slice(x, 1, 32), F.slice(x, 33, 32))), "list_transform(range(1, 33), lambda i: (x[i] + x[i + 32]) / 2)")
_long("p6_first_seconds", lambda x: S.first_seconds(x, 2.0, 16), "x[1:32]")
_long(
    "p7_padded_slice",
    lambda x: S.seconds(x, F.col("label") * F.lit(0.25), F.col("label") * F.lit(0.25) + F.lit(0.7), 16, 0.1),
    "x[CAST(greatest(0, floor((label * 0.25::DOUBLE - 0.1::DOUBLE) * 16)) AS INTEGER) + 1 : CAST(least(n, floor((label * 0.25::DOUBLE + 0.7::DOUBLE + 0.1::DOUBLE) * 16)) AS INTEGER)]",
)
_long(
    "p12_probabilities",
    S.renormalised,
    "list_transform(CASE WHEN list_min(x) < 0 THEN list_transform(x, lambda v: exp(v)) ELSE x END, lambda v: least(1, greatest(0, v)) / (list_sum(list_transform(CASE WHEN list_min(x) < 0 THEN list_transform(x, lambda u: exp(u)) ELSE x END, lambda w: least(1, greatest(0, w)))) + 1e-12::DOUBLE))",
)
_long("p16_align_length", lambda x: S.aligned(F.slice(x, 1, 60 + F.col("label")), F.lit(66)), "CASE WHEN 60 + label >= 66 THEN x[1:least(64, 60 + label)] ELSE x[1:60 + label] END || list_transform(range(66 - least(64, 60 + label)), lambda i: x[least(64, 60 + label)])")
_long("p18_checked_embedding", lambda x: S.conditioned(F.when(F.col("label") < 5, x).otherwise(F.slice(x, 1, 32)), 64, F.array_repeat(F.lit(0.5), 64)), "CASE WHEN label < 5 THEN x ELSE list_transform(x, lambda v: 0.5::DOUBLE) END")
_long("p19_finite", lambda x: S.finite(F.transform(x, lambda v, i: F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 7 == 1, F.lit(float("inf"))).otherwise(v))), "list_transform(x, lambda v, i: CASE WHEN (i - 1) % 7 < 2 THEN 0 ELSE v END)")
_long("p20_log_f0", lambda x: S.log_f0(F.transform(x, lambda v: v * 20)), "list_transform(x, lambda v: CASE WHEN v * 20 > 1 THEN ln(v * 20 + 1e-6::DOUBLE) ELSE 0 END)")
_long("p21_energy_gain", lambda x: S.gained(x, S.rms(x), F.lit(0.3)), "list_transform(x, lambda v: greatest(-1::DOUBLE, least(1::DOUBLE, v * (0.3::DOUBLE / greatest(sqrt(e / n), 1e-6::DOUBLE)))))")
_one("p22_snr_db", lambda x: S.snr_db(x, F.transform(x, lambda v, i: v + F.lit(0.001) * (i % 5))), "10 * log10((e / n) / (list_sum(list_transform(x, lambda v, i: pow((v + 0.001::DOUBLE * ((i - 1) % 5)) - v, 2))) / n))")
_one("p23_epsilon_for_snr", lambda x: S.epsilon_for_snr(x, 0.05, 20.0), "least(0.05::DOUBLE, sqrt((e / n) / pow(10::DOUBLE, 2::DOUBLE)) * 0.999::DOUBLE)")
_long("w2_overlapping_chunks", lambda x: F.flatten(S.chunks(x, 24, 8)), "flatten(list_transform(range(0, n - 24 + 1, 8), lambda a: x[a + 1:a + 24]))")
_long("w3_frame_powers", lambda x: S.frame_powers(x, 8), "list_transform(range(0, n - 8, 8), lambda a: list_sum(list_transform(x[a + 1:a + 8], lambda v: v * v)) / 8)")
_long("w4_centred_rms", lambda x: S.centred_rms(x, 16, 8), "list_transform(range(0, n + 1, 8), lambda a: sqrt(list_sum(list_transform(x[greatest(1, a - 7):least(n, a + 8)], lambda v: v * v)) / 16))")
_long("w6_sample_curve", lambda x: S.sample_curve(x, F.size(x) * 8 + 6, 8), "list_transform(range(n * 8 + 6), lambda i: x[least(i // 8, n - 1) + 1] + (x[least(i // 8 + 1, n - 1) + 1] - x[least(i // 8, n - 1) + 1]) * (i / 8.0::DOUBLE - i // 8))")
_long("w7_join_with_gaps", lambda x: S.joined(F.array(F.slice(x, 1, 40), F.slice(x, 41, F.size(x))), 4), "x[1:40] || [0, 0, 0, 0]::DOUBLE[] || x[41:]")
_long("m7_dct_ii", lambda x: S.dct_ii(x, 20), "list_transform(range(20), lambda k: list_sum(list_transform(x, lambda v, i: v * cos(3.141592653589793::DOUBLE * k * (i * 2 - 1) / (n * 2)))) * sqrt(CASE WHEN k = 0 THEN 1.0::DOUBLE / n ELSE 2.0::DOUBLE / n END))")
_one("l10_least_flipping_step", lambda x: S.sign_steps(x, F.transform(x, lambda v, i: F.when(i % 2 == 0, 0.5).otherwise(-0.25)), 1.0, 0.0, F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: k * F.lit(0.005))),
     "list_min(list_filter(list_transform(range(1, 41), lambda k: k * 0.005::DOUBLE), lambda s: list_sum(list_transform(x, lambda v, i: v * CASE WHEN i % 2 = 1 THEN 0.5::DOUBLE ELSE -0.25::DOUBLE END)) + 1 - s * 24 < 0))")


@query(
    "w1_sliding_frames",
    f"""WITH {SIGNALS}, f AS (SELECT vec_id, x, n, unnest(range(0, n, 5)) AS start FROM s)
SELECT vec_id, CAST(start // 5 AS INTEGER) AS frame_idx, CAST(start AS INTEGER) AS start, CAST(least(20, n - start) AS INTEGER) AS size, round(list_sum(x[start + 1:start + 20]), 6) + 0.0::DOUBLE AS total, 20::INTEGER AS padded
FROM f WHERE (n - start) / 20.0::DOUBLE >= 0.5""",
)
def sliding_frames(spark, sf_dir):
    rows = signals(spark, sf_dir).select("vec_id", F.explode(S.frames(F.col("x"), 20, 5)).alias("f")).select("vec_id", "f.*")
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)
    return rows.select("vec_id", "frame_idx", "start", "size", rounded(total).alias("total"), F.size("samples").alias("padded"))


@query(
    "p13_binary_probabilities",
    f"WITH {FRAMES} SELECT utt_id, frame_idx, round(a, 6) AS hi, round(b, 6) AS en, CASE WHEN a >= b THEN 'hi' ELSE 'en' END AS label FROM (SELECT *, prob_hi / (prob_hi + 0.7::DOUBLE + 1e-12) AS a, 0.7::DOUBLE / (prob_hi + 0.7::DOUBLE + 1e-12) AS b FROM frames)",
)
def binary_probabilities(spark, sf_dir):
    from ..operators.segments import binary_probabilities as two

    hi, en, label = two(F.col("prob_hi"), F.lit(0.7))
    return frames(spark, sf_dir).select("utt_id", "frame_idx", F.round(hi, 6).alias("hi"), F.round(en, 6).alias("en"), label.alias("label"))


@query("l2_cosine", "WITH s AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), c AS (SELECT label, min(vec_id) AS head FROM s GROUP BY label) SELECT s.vec_id, round(list_inner_product(s.x, h.x) / sqrt(list_inner_product(s.x, s.x) * list_inner_product(h.x, h.x)), 6) + 0.0::DOUBLE AS cosine FROM s JOIN c USING (label) JOIN s h ON h.vec_id = c.head")
def cosine(spark, sf_dir):
    rows = signals(spark, sf_dir)
    heads = rows.groupBy("label").agg(F.min("vec_id").alias("head")).join(rows.select(F.col("vec_id").alias("head"), F.col("x").alias("h")), "head").select("label", "h")
    return rows.join(heads, "label").select("vec_id", rounded(S.cosine(F.col("x"), F.col("h"))).alias("cosine"))


@query("l5_pooled_features", f"WITH {SIGNALS} SELECT vec_id, round(list_sum(x) / n, 6) + 0.0::DOUBLE AS mean, round(sqrt(list_sum(list_transform(x, lambda v: pow(v - list_sum(x) / n, 2))) / n), 6) AS std FROM s")
def pooled(spark, sf_dir):
    both = signals(spark, sf_dir).select("vec_id", S.pooled(F.col("x")).alias("p"))
    return both.select("vec_id", rounded("p.mean").alias("mean"), F.round("p.std", 6).alias("std"))


@query(
    "r7_snr_estimate",
    f"WITH {FRAMES} SELECT utt_id, round(10 * log10(quantile_cont(prob_hi, 0.95) / (quantile_cont(prob_hi, 0.05) + 1e-12::DOUBLE)), 6) + 0.0::DOUBLE AS snr_db FROM frames GROUP BY utt_id",
)
def snr_estimate(spark, sf_dir):
    found = scoring.snr_estimate(frames(spark, sf_dir).select("utt_id", F.col("prob_hi").alias("power")))
    return found.select("utt_id", rounded("snr_db").alias("snr_db"))


@query("r8_median_voiced", "SELECT user_id AS utt_id, round(median(value), 6) AS f0 FROM events WHERE value > 1 GROUP BY user_id")
def median_voiced(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value > 1").groupBy(F.col("user_id").alias("utt_id")).agg(F.round(F.median("value"), 6).alias("f0"))


@query("r9_noise_floor", f"WITH {SIGNALS}, b AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, unnest(range(n)) AS bin, unnest(x) AS v FROM s) SELECT label, CAST(bin AS INTEGER) AS bin, round(avg(v * v), 6) AS noise FROM b WHERE k <= 10 GROUP BY label, bin")
def noise_floor(spark, sf_dir):
    """Mean power of the first ten frames of each bin: a signal is a frame of its label, a place a bin."""
    return spectral.noise_floor(signals(spark, sf_dir).select(F.col("label").alias("utt_id"), F.col("vec_id").alias("frame_idx"), F.posexplode("x").alias("bin", "v")).select("utt_id", "frame_idx", "bin", (F.col("v") * F.col("v")).alias("power"))).select(F.col("utt_id").alias("label"), "bin", F.round("noise", 6).alias("noise"))


@query("m9_spectral_floor", f"WITH {SIGNALS}, b AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, unnest(range(n)) AS bin, unnest(x) AS v FROM s), z AS (SELECT label, bin, avg(v * v) AS noise FROM b WHERE k <= 10 GROUP BY label, bin) SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(greatest(v * v - 2 * noise, 0.002::DOUBLE * v * v), 6) AS power FROM b JOIN z USING (label, bin)")
def spectral_floor(spark, sf_dir):
    powers = signals(spark, sf_dir).select(F.col("label").alias("utt_id"), F.col("vec_id").alias("frame_idx"), F.posexplode("x").alias("bin", "v")).select("utt_id", "frame_idx", "bin", (F.col("v") * F.col("v")).alias("power"))
    return spectral.subtracted(powers).select(F.col("frame_idx").alias("vec_id"), "bin", F.round("power", 6).alias("power"))


def _features(kind: str) -> None:
    @query(f"m_features_{kind}", f"WITH {SIGNALS}, {Z.cepstra(kind)} SELECT vec_id, CAST(k AS INTEGER) AS frame_idx, CAST(c AS INTEGER) AS c, round(v, 4) + 0.0::DOUBLE AS v FROM cepstra")
    def run(spark, sf_dir):
        rows = spectral.features(spectral.tones(signals(spark, sf_dir)), kind)
        return rows.select("vec_id", "frame_idx", F.posexplode("coefficients").alias("c", "v")).select("vec_id", "frame_idx", "c", rounded("v", 4).alias("v"))


for _kind in spectral.KINDS:
    _features(_kind)


def _parts(rows, size: int):
    """Sums and energies of parts of so many samples."""
    each = rows.select("vec_id", F.posexplode("y").alias("i", "v")).groupBy("vec_id", F.floor(F.col("i") / size).alias("part"))
    return each.agg(F.count("*").alias("n"), rounded(F.sum("v"), 5).alias("total"), rounded(F.sum(F.col("v") * F.col("v")), 5).alias("energy"))


def _parts_sql(size: int) -> str:
    return f"SELECT vec_id, i // {size} AS part, count(*) AS n, round(sum(v), 5) + 0.0::DOUBLE AS total, round(sum(v * v), 5) + 0.0::DOUBLE AS energy FROM samples GROUP BY ALL"


@query("p5_resample", f"WITH {SIGNALS}, {Z.HALVED} {_parts_sql(20)}")
def resample(spark, sf_dir):
    return _parts(spectral.resampled(spectral.tones(signals(spark, sf_dir)), 16_000, 8_000), 20)


@query("m9_spectral_subtraction", f"WITH {SIGNALS}, {Z.SUBTRACTED} {_parts_sql(40)}")
def spectral_subtraction(spark, sf_dir):
    return _parts(spectral.denoised(spectral.tones(signals(spark, sf_dir))), 40)


@query("m10_denoise_strategies", f"WITH {SIGNALS}, {Z.TONES}, samples AS (SELECT vec_id, unnest(y) AS v, unnest(range(len(y))) AS i FROM tone) {_parts_sql(400)}")
def denoise_strategies(spark, sf_dir):
    """The strategy that leaves signals as they are."""
    return _parts(spectral.denoised(spectral.tones(signals(spark, sf_dir)), "none"), 400)


@query("m11_pitch_contour", f"WITH {SIGNALS}, {Z.PITCH} SELECT vec_id, CAST(k AS INTEGER) AS frame_idx, round(k * 256 / 16000.0::DOUBLE, 6) AS t, round(f0, 3) + 0.0::DOUBLE AS f0, round(energy, 6) AS energy FROM pitch JOIN louds USING (vec_id, k)")
def pitch_contour(spark, sf_dir):
    found = spectral.contours(spectral.tones(signals(spark, sf_dir)))
    return found.select("vec_id", "frame_idx", rounded("t").alias("t"), rounded("f0", 3).alias("f0"), rounded("energy").alias("energy"))


@query("m12_shifted_pitch", "SELECT vec_id, 4000 AS n, 1.0::DOUBLE AS measured, CASE WHEN label % 2 = 0 THEN 1.25::DOUBLE ELSE 0.8::DOUBLE END AS ratio FROM embeddings")
def shifted_pitch(spark, sf_dir):
    """A tone for each vector, as high as its id says, with its pitch changed by a ratio after its label: what the pitch then measures over what it should."""
    rows = signals(spark, sf_dir).select("vec_id", F.when(F.col("label") % 2 == 0, 1.25).otherwise(0.8).alias("ratio"), (F.lit(150.0) + 10 * (F.col("vec_id") % 8)).alias("f0"))
    # a few bytes a row become 4,000 samples: dealt over so many tasks before that, which a count given here keeps from being joined again
    tones = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id").select("vec_id", "ratio", F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: F.lit(0.3) * F.sin(2 * math.pi * F.col("f0") * i / 16_000)).alias("x"))
    y = pitch.shifted(tones).select("vec_id", F.col("y").alias("x"), F.size("y").alias("n"))
    heard = spectral.contours(y, ("n",)).where("f0 > 0").groupBy("vec_id").agg(F.median("f0").alias("heard"), F.max("n").alias("n"))
    measured = F.round(F.col("heard") / (F.col("f0") * F.col("ratio")), 1)
    return rows.join(heard, "vec_id").select("vec_id", "n", measured.alias("measured"), "ratio")
