"""Mapping the prosody of one utterance onto another: features, alignment, warped curves, gain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from .align import dtw_paths
from .segments import forward_filled


def _less(mean: str):
    return lambda v: v - F.col(mean)


def _over(deviation: str):
    return lambda v: F.when(F.col(deviation) < 1e-8, 0.0).otherwise(v / F.col(deviation))


def _standard(rows: DataFrame, *columns: str) -> DataFrame:
    """Each array column with mean 0 and deviation 1, constant ones 0. Mean and deviation are columns first, so that no lambda works them out again for each value."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    rows = rows.withColumns({f"{c}_mean": total(F.col(c)) / F.size(c) for c in columns})
    rows = rows.withColumns({c: F.transform(c, _less(f"{c}_mean")) for c in columns})
    rows = rows.withColumns({f"{c}_dev": F.sqrt(total(F.transform(c, lambda v: v * v)) / F.size(c)) for c in columns})
    held = {c: F.transform(c, _over(f"{c}_dev")) for c in columns}
    return rows.withColumns(held).drop(*(f"{c}_{k}" for c in columns for k in ("mean", "dev")))


def prosody_features(pairs: DataFrame) -> DataFrame:
    """pair_id, a, b: frames of (log pitch, energy), each with mean 0 and deviation 1 over its signal."""
    rows = pairs.select("pair_id", *(signal.log_f0(F.col(f"f0_{p}")).alias(f"f0_{p}") for p in "ab"), "energy_a", "energy_b")
    rows = _standard(rows, "f0_a", "energy_a", "f0_b", "energy_b")
    return rows.select("pair_id", *(F.zip_with(f"f0_{p}", f"energy_{p}", lambda x, y: F.array(x, y)).alias(p) for p in "ab"))


def prosody_paths(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, f0_a, energy_a, f0_b, energy_b) to pair_id, cost, path: exact alignment of a with b."""
    return dtw_paths(prosody_features(pairs))


def mapped_prosody(pairs: DataFrame, hop: int) -> DataFrame:
    """pairs(..., x: the samples of b) to pair_id, f0 and energy (a's curves on b's frames; pitch of at most 1 is unvoiced) and x with a's energy.

    The pitch of the samples stays: there is no vocoder.
    """
    rows = prosody_paths(pairs).select("pair_id", "path").join(pairs.select("pair_id", "f0_a", "energy_a"), "pair_id")
    steps = rows.select("pair_id", "f0_a", "energy_a", F.explode("path").alias("p")).select("pair_id", "p.j", F.get("f0_a", "p.i").alias("f0"), F.get("energy_a", "p.i").alias("energy"))
    curves = steps.groupBy("pair_id", "j").agg(F.avg("f0").alias("f0"), F.avg("energy").alias("energy"))  # a path meets every frame of b
    for name in ("f0", "energy"):
        curves = forward_filled(curves, name, "j", "pair_id").drop(name).withColumnRenamed("filled", name)
    curves = curves.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("j", "f0", "energy"))).alias("frames"))  # the frames of one utterance
    rows = pairs.select("pair_id", "energy_b", "x").join(curves.select("pair_id", "frames.f0", "frames.energy"), "pair_id")
    # a column first, so that the lambda doesn't work it out again for each sample
    rows = rows.withColumn("gain", F.zip_with("energy", "energy_b", lambda a, b: a / F.greatest(b, F.lit(1e-6))))
    each = signal.sample_curve(F.col("gain"), F.size("x"), hop)
    held = F.zip_with("x", each, lambda v, g: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * g)))
    return rows.select("pair_id", F.transform("f0", lambda v: F.when(v > 1, v).otherwise(0.0)).alias("f0"), "energy", held.alias("x"))
