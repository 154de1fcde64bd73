"""Spectra of signals: relational noise floors, and Arrow-batched numpy kernels for transforms that SQL functions can't express.

A row is one signal; a task holds one signal and its frames at a time.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shared import pieces

N_FFT, WINDOW, HOP = 512, 400, 160


def noise_floor(powers: DataFrame, first: int = 10) -> DataFrame:
    """powers(utt_id, frame_idx, bin, power): the mean power of each bin over the first frames."""
    place = F.dense_rank().over(Window.partitionBy("utt_id").orderBy("frame_idx"))
    early = powers.select("utt_id", "frame_idx").distinct().withColumn("place", place).where(F.col("place") <= first).drop("place")
    return powers.join(early, ["utt_id", "frame_idx"]).groupBy("utt_id", "bin").agg(F.avg("power").alias("noise"))


def subtracted(powers: DataFrame, over: float = 2.0, least: float = 0.002) -> DataFrame:
    """Powers less `over` times the noise floor, at least `least` of what they were."""
    return powers.join(noise_floor(powers), ["utt_id", "bin"]).withColumn("power", F.greatest(F.col("power") - F.lit(over) * F.col("noise"), F.lit(least) * F.col("power"))).drop("noise")


def tones(signals: DataFrame, seconds: float = 0.25, rate: int = 16_000) -> DataFrame:
    """vec_id, x: a stand-in for audio, made of the values of a short signal as strengths of tones 120, 240, ... Hz."""
    t = np.arange(int(seconds * rate))[:, None] * (2 * np.pi * 120 / rate)
    return _mapped(signals, lambda x: [((np.sin(t * np.arange(1, len(x) + 1)) @ x).tolist(),)], "x array<double>")


def _framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames centred at multiples of the hop, mirrored at the ends (zeros for signals too short for that)."""
    half = size // 2
    padded = np.pad(x, half, mode="reflect" if len(x) > half else "constant")
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]


def _hann(size: int, n_fft: int) -> np.ndarray:
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    before = (n_fft - size) // 2
    return np.pad(window, (before, n_fft - size - before))


def spectrum(x: np.ndarray, n_fft: int = N_FFT, window: int = WINDOW, hop: int = HOP) -> np.ndarray:
    """Frames by bins, complex."""
    return np.fft.rfft(_framed(x, n_fft, hop) * _hann(window, n_fft), axis=1)


def inverse(spec: np.ndarray, n: int, n_fft: int, window: int, hop: int) -> np.ndarray:
    """Overlap-add of windowed frames over the sum of squared windows."""
    w = _hann(window, n_fft)
    frames = np.fft.irfft(spec, n_fft, axis=1) * w
    out, norm = np.zeros((len(spec) - 1) * hop + n_fft), np.zeros((len(spec) - 1) * hop + n_fft)
    for k, f in enumerate(frames):
        out[k * hop : k * hop + n_fft] += f
        norm[k * hop : k * hop + n_fft] += w * w
    out = out / np.where(norm > 1e-10, norm, 1.0)
    cut = out[n_fft // 2 : n_fft // 2 + n]
    return np.pad(cut, (0, n - len(cut)))


def triangles(edges: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Filters that rise from one edge to the next and fall to the one after."""
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((freqs - left) / (mid - left), (right - freqs) / (right - mid)))


def dct_rows(x: np.ndarray, keep: int) -> np.ndarray:
    """Orthonormal DCT-II of each row."""
    n = x.shape[1]
    basis = np.cos(np.pi * np.arange(keep)[:, None] * (2 * np.arange(n) + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return x @ basis.T


KINDS = ("mfcc", "lfcc", "cqcc")


def cepstra(x: np.ndarray, kind: str, rate: int = 16_000) -> np.ndarray:
    """Frames by coefficients. mfcc: 40 mel bands, 13 coefficients after the first, no frames for a signal too short; lfcc: 40 even bands; cqcc: 84 log-spaced frequencies."""
    if kind not in KINDS:
        raise ValueError(f"unknown features {kind!r}: one of {', '.join(KINDS)}")
    keep = {"mfcc": 14, "lfcc": 20, "cqcc": 20}[kind]
    if len(x) < N_FFT // 2 + 1:
        return np.zeros((0, keep - 1)) if kind == "mfcc" else np.zeros((1, keep))
    power = np.abs(spectrum(x)) ** 2
    freqs = np.fft.rfftfreq(N_FFT, 1 / rate)
    if kind == "cqcc":
        wanted = np.minimum(32.7 * 2 ** (np.arange(84) / 12), rate / 2)
        bands = np.stack([np.interp(wanted, freqs, row) for row in np.log(np.maximum(power, 1e-10))])
    else:
        mel = lambda f: 2595 * np.log10(1 + f / 700)
        edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), 42) / 2595) - 1) if kind == "mfcc" else np.linspace(0, rate / 2, 42)
        bands = np.log(power @ triangles(edges, freqs).T + 1e-6)
    out = dct_rows(bands, keep)
    return out[:, 1:] if kind == "mfcc" else out


def normalised(matrix: np.ndarray) -> np.ndarray:
    """Zero mean and unit variance of each coefficient; constant ones are only centred, NaN becomes 0."""
    std = matrix.std(axis=0)
    return np.nan_to_num((matrix - matrix.mean(axis=0)) / np.where(std < 1e-8, 1.0, std))


def _mapped(signals: DataFrame, one: Callable[..., list[tuple]], columns: str, more: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """signals(vec_id, x): rows of one() for each signal and its values of the columns `more`."""
    schema = f"vec_id long, {columns}"
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for part in (p for batch in batches for p in pieces(batch)):
            keys, xs = part.column(0).to_pylist(), part.column(1)
            also = [part.column(2 + i).to_pylist() for i in range(len(more))]
            # a null signal is an empty one
            rows = [(key, *r) for key, x, *values in zip(keys, xs, *also) for r in one(np.asarray(x.values.to_numpy(zero_copy_only=False) if x.is_valid else [], float), *values)]
            yield pa.RecordBatch.from_pylist([dict(zip(made.names, r, strict=True)) for r in rows], made)

    return signals.select("vec_id", "x", *more).mapInArrow(run, schema)


def features(signals: DataFrame, kind: str) -> DataFrame:
    """vec_id, frame_idx, coefficients: normalised cepstra; mfcc, which distances are taken of, as they are."""
    if kind not in KINDS:
        raise ValueError(f"unknown features {kind!r}: one of {', '.join(KINDS)}")
    finish = (lambda m: m) if kind == "mfcc" else normalised
    return _mapped(signals, lambda x: [(i, row.tolist()) for i, row in enumerate(finish(cepstra(x, kind)))], "frame_idx int, coefficients array<double>")


def resample(x: np.ndarray, source: int, target: int, zeros: int = 16) -> np.ndarray:
    """Windowed-sinc interpolation at the times of the new rate."""
    if source == target or not len(x):
        return x
    n = -(-len(x) * target // source)
    cut = min(1.0, target / source)
    reach = int(np.ceil(zeros / cut))
    at = np.arange(n) * source / target
    taps = np.floor(at).astype(int)[:, None] + np.arange(-reach, reach + 1)
    gap = at[:, None] - taps
    weights = cut * np.sinc(cut * gap) * np.where(np.abs(gap) <= reach, 0.5 + 0.5 * np.cos(np.pi * gap / reach), 0.0)
    inside = (taps >= 0) & (taps < len(x))
    return (weights * np.where(inside, x[np.clip(taps, 0, len(x) - 1)], 0.0)).sum(1)


def resampled(signals: DataFrame, source: int, target: int) -> DataFrame:
    return _mapped(signals, lambda x: [(resample(x, source, target).tolist(),)], "y array<double>")


def denoise(x: np.ndarray, first: int = 10, over: float = 2.0, least: float = 0.002) -> np.ndarray:
    """Spectral subtraction with the phase as it was."""
    spec = spectrum(x, 512, 512, 128)
    power = np.abs(spec) ** 2
    kept = np.maximum(power - over * power[:first].mean(axis=0), least * power)
    return inverse(np.sqrt(kept) * np.exp(1j * np.angle(spec)), len(x), 512, 512, 128)


STRATEGIES = {"spectral": denoise, "none": lambda x: x}


def denoised(signals: DataFrame, strategy: str | None = None) -> DataFrame:
    """vec_id, y. The strategy is one of STRATEGIES; the variable DENOISE_BACKEND of the driver goes before the argument."""
    strategy = os.environ.get("DENOISE_BACKEND") or strategy or "spectral"
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown way to denoise {strategy!r}: one of {', '.join(STRATEGIES)}")
    if strategy == "none":
        return signals.select("vec_id", F.col("x").alias("y"))
    one = STRATEGIES[strategy]
    return _mapped(signals, lambda x: [(one(x).tolist(),)], "y array<double>")


def pitch(x: np.ndarray, rate: int = 16_000, low: float = 50.0, high: float = 500.0, size: int = 1024, hop: int = 256, limit: float = 0.15) -> np.ndarray:
    """The published difference-function method: the first dip under the limit of the cumulative mean normalised difference; 0 without one."""
    frames = _framed(x, 2 * size, hop)
    spec = np.fft.rfft(frames, 4 * size, axis=1)
    head = np.fft.rfft(frames[:, :size], 4 * size, axis=1)
    cross = np.fft.irfft(spec * np.conj(head), axis=1)[:, :size]
    energy = np.cumsum(np.pad(frames**2, ((0, 0), (1, 0))), axis=1)
    lags = np.arange(size)
    gap = energy[:, size : size + 1] + energy[:, lags + size] - energy[:, lags] - 2 * cross
    scaled = gap * lags / np.maximum(np.cumsum(gap, axis=1), 1e-12)
    a, b = int(rate / high), min(size - 2, int(rate / low))
    out = np.zeros(len(frames))
    for k, d in enumerate(scaled):
        under = np.flatnonzero(d[a:b] < limit)
        if len(under) and energy[k, -1] > 1e-8:
            lag = a + int(under[0])
            while lag + 1 < b and d[lag + 1] < d[lag]:
                lag += 1
            bend = d[lag - 1] - 2 * d[lag] + d[lag + 1]
            out[k] = rate / (lag + (0.5 * (d[lag - 1] - d[lag + 1]) / bend if abs(bend) > 1e-12 else 0.0))
    return out


def contours(signals: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, frame_idx, t, f0, energy of frames every 256 samples, and the carried columns of their signal."""

    def one(x: np.ndarray, *values) -> list[tuple]:
        f0, energy = pitch(x), np.sqrt((_framed(x, 1024, 256) ** 2).mean(axis=1))
        return [(i, i * 256 / 16_000, float(f), float(e), *values) for i, (f, e) in enumerate(zip(f0, energy))]

    more = "".join(f", {c} {signals.schema[c].dataType.simpleString()}" for c in carried)
    return _mapped(signals, one, f"frame_idx int, t double, f0 double, energy double{more}", carried)
