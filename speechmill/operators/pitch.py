"""Changing the pitch of signals and not their length: a stretch by running phases, and resampling.

The frames of a signal of up to LONG samples are arrays of one task, signal by signal, so nothing of them is shuffled or written. A longer signal's frames, bins and
samples are rows, of which no task holds all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .spectral import _hann, _mapped, inverse, resample, spectrum

N_FFT, HOP = 1024, 256
#: Samples of the longest signal that is stretched within a task (65 s at 16,000 a second, whose frames take 34 MB).
LONG = 1 << 20


def stretched(spec: np.ndarray, ratio: float) -> np.ndarray:
    """Frames by bins of one signal, ratio times as many frames: what stretched_bins() does by rows."""
    mag, phase = np.abs(spec), np.angle(spec)
    wide = 2 * np.pi * HOP / N_FFT * np.arange(spec.shape[1])
    turn = np.diff(phase, axis=0) - wide
    step = np.vstack([wide + turn - 2 * np.pi * np.round(turn / (2 * np.pi)), wide])
    most = int(np.floor((len(spec) - 1) * ratio))
    at = np.arange(most + 1) / ratio
    k = np.minimum(np.floor(at).astype(int), len(spec) - 1)
    part = (at - k)[:, None]
    anchor = min(most, int(np.ceil(N_FFT / 2 / HOP * ratio)))
    run = np.cumsum(step[k], axis=0) - step[k]
    start = phase[k[anchor]] + part[anchor] * step[k[anchor]] - run[anchor]
    return ((1 - part) * mag[k] + part * np.vstack([mag[1:], np.zeros_like(mag[:1])])[k]) * np.exp(1j * (start + run))


def moved(x: np.ndarray, ratio: float) -> np.ndarray:
    """One signal with its pitch times the ratio."""
    spec = stretched(spectrum(x, N_FFT, N_FFT, HOP), ratio)
    long = inverse(spec, (len(spec) - 1) * HOP + N_FFT // 2, N_FFT, N_FFT, HOP)
    return fitted(long, ratio, len(x))


def fitted(long: np.ndarray, ratio: float, n: int) -> np.ndarray:
    """A stretched signal resampled to n samples."""
    y = resample(long, round(ratio * 10_000), 10_000)[:n]
    return np.pad(y, (0, n - len(y)))


def bins(signals: DataFrame) -> DataFrame:
    """signals(vec_id, x) to vec_id, k, f, mag, phase: frames by bins, a row for each."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for key, x in zip(pdf["vec_id"], pdf["x"], strict=True):
                spec = spectrum(np.asarray(x if x is not None else [], float), N_FFT, N_FFT, HOP)
                k, f = np.indices(spec.shape)
                yield pd.DataFrame({"vec_id": key, "k": k.ravel(), "f": f.ravel(), "mag": np.abs(spec).ravel(), "phase": np.angle(spec).ravel()})

    return signals.select("vec_id", "x").mapInPandas(run, "vec_id long, k int, f int, mag double, phase double")


def stretched_bins(spec: DataFrame, ratios: DataFrame) -> DataFrame:
    """spec with ratio(vec_id, ratio) times as many frames: magnitudes between two frames by place, phases as the running sum of what they advance by there."""
    order = Window.partitionBy("vec_id", "f").orderBy("k")
    wide = 2 * np.pi * HOP / N_FFT * F.col("f")
    turn = F.lead("phase").over(order) - F.col("phase") - wide
    step = wide + turn - 2 * np.pi * F.round(turn / (2 * np.pi))
    pairs = spec.withColumns({"mag_after": F.coalesce(F.lead("mag").over(order), F.lit(0.0)), "step": F.coalesce(step, wide)})
    last = spec.groupBy("vec_id").agg(F.max("k").alias("last")).join(ratios, "vec_id")
    most = F.floor(F.col("last") * F.col("ratio")).cast("int")
    # bins agree on their phases at the first frame without mirrored samples, and so do the sums that start there
    anchor = F.least(most, F.ceil(N_FFT / 2 / HOP * F.col("ratio")).cast("int"))
    frames = last.select("vec_id", "ratio", anchor.alias("anchor"), F.explode(F.sequence(F.lit(0), most)).alias("m"))
    frames = frames.select("vec_id", "m", "anchor", F.floor(F.col("m") / F.col("ratio")).cast("int").alias("k"), (F.col("m") / F.col("ratio") - F.floor(F.col("m") / F.col("ratio"))).alias("part"))
    rows = pairs.join(frames, ["vec_id", "k"])
    before = Window.partitionBy("vec_id", "f").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("run", F.coalesce(F.sum("step").over(before), F.lit(0.0)))
    start = F.max(F.when(F.col("m") == F.col("anchor"), F.col("phase") + F.col("part") * F.col("step") - F.col("run"))).over(Window.partitionBy("vec_id", "f"))
    return rows.select("vec_id", F.col("m").alias("k"), "f", ((1 - F.col("part")) * F.col("mag") + F.col("part") * F.col("mag_after")).alias("mag"), (start + F.col("run")).alias("phase"))


def samples(spec: DataFrame) -> DataFrame:
    """vec_id, i, v: overlapping frames laid out by place and summed, over the sum of squared windows."""
    listed = F.array_sort(F.collect_list(F.struct("f", "mag", "phase")))  # the bins of one frame
    rows = spec.groupBy("vec_id", "k").agg(listed.alias("s")).select("vec_id", "k", "s.mag", "s.phase")

    def run(batches):
        import pandas as pd

        w = _hann(N_FFT, N_FFT)
        for pdf in batches:
            mag, phase = (np.array(pdf[c].tolist()).reshape(len(pdf), -1) for c in ("mag", "phase"))
            frames = np.fft.irfft(mag * np.exp(1j * phase), N_FFT, axis=1) * w if len(pdf) else np.zeros((0, N_FFT))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "k": pdf["k"], "v": list(frames)})

    frames = rows.mapInPandas(run, "vec_id long, k int, v array<double>").withColumn("last", F.max("k").over(Window.partitionBy("vec_id")))
    laid = frames.select("vec_id", "last", "k", F.posexplode("v").alias("j", "v")).select("vec_id", "last", (F.col("k") * HOP + F.col("j")).alias("at"), "v").where(F.col("at") >= N_FFT // 2)
    sums = laid.groupBy("vec_id", "last", "at").agg(F.sum("v").alias("v"))
    # the squared windows of the few frames that reach a place
    norm = F.lit(0.0)
    for back in range(N_FFT // HOP):
        k = F.floor(F.col("at") / HOP) - back
        w = 0.5 - 0.5 * F.cos(2 * np.pi * (F.col("at") - k * HOP) / N_FFT)
        norm = norm + F.when((k >= 0) & (k <= F.col("last")), w * w).otherwise(0.0)
    return sums.select("vec_id", (F.col("at") - N_FFT // 2).alias("i"), (F.col("v") / F.when(norm > 1e-10, norm).otherwise(1.0)).alias("v"))


def shifted(signals: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """signals(vec_id, x) with their pitch times ratios(vec_id, ratio), or their own column ratio, and their length as it was: vec_id, y. Signals without a ratio, with one of 1, or without samples stay.

    The signal is stretched to ratio times its length at its own pitch, then resampled to its length.
    """
    known = (signals if ratios is None else signals.join(ratios, "vec_id", "left")).withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    size = F.coalesce(F.size("x"), F.lit(0))
    moves = (F.abs(F.col("ratio") - 1) > 1e-9) & (F.col("ratio") > 0) & (size > 0)
    here = _mapped(known.where(moves & (size <= LONG)), lambda x, ratio: [(moved(x, ratio).tolist(),)], "y array<double>", ["ratio"])
    return here.unionByName(_shifted_by_rows(known.where(moves & (size > LONG)))).unionByName(known.where(~moves).select("vec_id", F.col("x").alias("y")))


def _shifted_by_rows(todo: DataFrame) -> DataFrame:
    """todo(vec_id, x, ratio): vec_id, y of signals of any length."""
    long = samples(stretched_bins(written(bins(todo), "bins"), todo.select("vec_id", "ratio")))
    listed = long.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select("vec_id", F.col("s.v").alias("long"))  # the samples of one signal
    rows = todo.select("vec_id", "ratio", F.size("x").alias("n")).join(listed, "vec_id")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(key, fitted(np.asarray(x, float), ratio, n).tolist()) for key, ratio, n, x in pdf[["vec_id", "ratio", "n", "long"]].itertuples(index=False)]
            yield pd.DataFrame(out, columns=["vec_id", "y"])

    return rows.mapInPandas(run, "vec_id long, y array<double>")


def ratios_of(source: DataFrame, target: DataFrame) -> DataFrame:
    """vec_id, ratio: the median of the voiced frames of source(vec_id, f0) over that of target(vec_id, f0); none where either has no voiced frame."""
    middle = lambda df, name: df.where("f0 > 1").groupBy("vec_id").agg(F.median("f0").alias(name))
    return middle(source, "a").join(middle(target, "b"), "vec_id").select("vec_id", (F.col("a") / F.col("b")).alias("ratio"))
