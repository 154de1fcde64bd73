"""Functions on signals held as arrays of double, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def rms(x: Column) -> Column:
    return F.sqrt(F.when(F.size(x) > 0, _sum(F.transform(x, lambda v: v * v)) / F.size(x)).otherwise(0.0))


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0))


def scaled(x: Column, gain: Column, clip: bool = True) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * gain)) if clip else v * gain)


def decibel_gain(level: Column, target_dbfs: float) -> Column:
    return F.pow(F.lit(10.0), (F.lit(target_dbfs) - F.lit(20.0) * F.log10(level + F.lit(1e-9))) / F.lit(20.0))


def rms_normalised(x: Column, target_dbfs: float = -23.0) -> Column:
    return scaled(x, decibel_gain(rms(x), target_dbfs))


def peak_normalised_dbfs(x: Column, target_dbfs: float = -23.0) -> Column:
    return scaled(x, decibel_gain(peak(x), target_dbfs))


def peak_normalised(x: Column, to: float = 0.9) -> Column:
    p = peak(x)
    return F.when(p > 0, F.transform(x, lambda v: v / p * to)).otherwise(x)


def snr_db(clean: Column, noisy: Column) -> Column:
    """Infinite where the noise has no power to speak of."""
    noise = F.zip_with(noisy, clean, lambda a, b: a - b)
    n, s = (_sum(F.transform(v, lambda e: e * e)) / F.size(v) for v in (noise, clean))
    return F.when(n <= 1e-20, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(s / n))


def epsilon_for_snr(x: Column, epsilon: float, snr: float) -> Column:
    """The largest step of sign noise that keeps an SNR, a little under it."""
    power = _sum(F.transform(x, lambda v: v * v)) / F.size(x)
    return F.least(F.lit(epsilon), F.sqrt(power / F.pow(F.lit(10.0), F.lit(snr / 10.0))) * 0.999)


def finite(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def log_f0(f0: Column) -> Column:
    return F.transform(f0, lambda v: F.when(v > 1.0, F.ln(v + F.lit(1e-6))).otherwise(0.0))


def aligned(x: Column, n: Column) -> Column:
    """Cut to n, or filled with the last value (zeros where there is none)."""
    size = F.size(x)
    fill = F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit(0.0))
    return F.when(size >= n, F.slice(x, 1, n)).otherwise(F.concat(x, F.array_repeat(fill, F.greatest(F.lit(0), n - size))))


def seconds(x: Column, start: Column, stop: Column, rate: int, pad: float = 0.0) -> Column:
    """Samples from start to stop, widened by pad and held inside the signal."""
    a = F.greatest(F.lit(0), F.floor((start - pad) * rate).cast("int"))
    b = F.least(F.size(x), F.floor((stop + pad) * rate).cast("int"))
    return F.slice(x, a + 1, F.greatest(F.lit(0), b - a))


def slice_or_error(x: Column, start: Column, long: Column, rate: int) -> Column:
    """`long` seconds from `start`; an error where the signal doesn't have all of them."""
    a, n = F.floor(start * rate).cast("int"), F.floor(long * rate).cast("int")
    cut = F.slice(x, a + 1, n)
    empty, short = F.raise_error(F.lit("the slice is empty")).cast("array<double>"), F.raise_error(F.lit("the slice is shorter than asked for")).cast("array<double>")
    return F.when(F.size(cut) == 0, empty).when(F.size(cut) < n, short).otherwise(cut)


def first_seconds(x: Column, most: float, rate: int) -> Column:
    return F.slice(x, 1, int(most * rate))


def frames(x: Column, window: int, hop: int, least: float = 0.5) -> Column:
    """Sliding windows as structs (frame_idx, start, size, samples). The first tail under `least` of a window ends the list; longer tails are padded."""
    n = F.size(x)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    kept = F.filter(starts, lambda s: (n - s) / F.lit(float(window)) >= least)
    return F.transform(
        kept,
        lambda s, i: F.struct(
            i.alias("frame_idx"), s.alias("start"), F.least(F.lit(window), n - s).alias("size"),
            F.concat(F.slice(x, s + 1, window), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(window) - (n - s)))).alias("samples"),
        ),
    )


def chunks(x: Column, size: int, hop: int) -> Column:
    """Overlapping chunks without a tail; a signal no longer than one chunk is the only chunk, unpadded."""
    n = F.size(x)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - size), F.lit(hop))
    return F.when(n <= size, F.array(x)).otherwise(F.transform(starts, lambda s: F.slice(x, s + 1, size)))


def frame_powers(x: Column, frame: int) -> Column:
    """Mean power of adjoining frames; an exact last frame is left out."""
    n = F.size(x)
    starts = F.when(n > frame, F.sequence(F.lit(0), n - frame - 1, F.lit(frame))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: _sum(F.transform(F.slice(x, s + 1, frame), lambda v: v * v)) / F.lit(float(frame)))


def centred_rms(x: Column, frame: int, hop: int) -> Column:
    """RMS of frames centred at multiples of the hop, zeros beyond the ends."""
    n, half = F.size(x), frame // 2
    starts = F.sequence(F.lit(0), n, F.lit(hop))
    cut = lambda s: F.slice(x, F.greatest(F.lit(1), s - half + 1), F.least(n, s + half) - F.greatest(F.lit(0), s - half))
    return F.transform(starts, lambda s: F.sqrt(_sum(F.transform(cut(s), lambda v: v * v)) / F.lit(float(frame))))


def sample_curve(curve: Column, n: Column, hop: int) -> Column:
    """A curve by frames, drawn linearly for each sample; its ends are held."""
    last = F.size(curve) - 1

    def at(i: Column) -> Column:
        k = F.floor(i / hop).cast("int")
        a, b = F.get(curve, F.least(k, last)), F.get(curve, F.least(k + 1, last))
        return a + (b - a) * (i / F.lit(float(hop)) - k)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def joined(parts: Column, gap: int) -> Column:
    """Signals one after the other with `gap` zeros between them."""
    n = F.size(parts)
    return F.flatten(F.transform(parts, lambda p, i: F.when(i < n - 1, F.concat(p, F.array_repeat(F.lit(0.0), gap))).otherwise(p)))


def renormalised(p: Column) -> Column:
    """Scores to probabilities: exponentials if any is negative, held within 0 and 1, then divided by their sum."""
    e = F.when(F.array_min(p) < 0, F.transform(p, F.exp)).otherwise(p)
    c = F.transform(e, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    total = _sum(c) + F.lit(1e-12)
    return F.transform(c, lambda v: v / total)


def pooled(x: Column) -> Column:
    mean = _sum(x) / F.size(x)
    return F.struct(mean.alias("mean"), F.sqrt(_sum(F.transform(x, lambda v: (v - mean) * (v - mean))) / F.size(x)).alias("std"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda u, v: u * v))
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dct_ii(x: Column, keep: int) -> Column:
    """Orthonormal DCT-II, the first `keep` values."""
    n = F.size(x)
    pi = 3.141592653589793

    def value(k: Column) -> Column:
        s = _sum(F.transform(x, lambda v, i: v * F.cos(F.lit(pi) * k * (i * 2 + 1) / (n * 2))))
        return s * F.sqrt(F.when(k == 0, 1.0 / n).otherwise(2.0 / n))

    return F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), value)


def mono(channels: Column) -> Column:
    """The mean over channels (an array of equally long signals)."""
    n = F.size(channels)
    return F.transform(channels[0], lambda _, i: F.aggregate(channels, F.lit(0.0), lambda a, c: a + F.get(c, i)) / n)


def gained(x: Column, level: Column, target: Column, least: float = 1e-6) -> Column:
    """x times target / level, held within 1."""
    return scaled(x, target / F.greatest(level, F.lit(least)))


def conditioned(embedding: Column, dim: int, fallback: Column) -> Column:
    """The embedding (array<double>) if it has the expected size, else the fallback."""
    return F.when(F.size(embedding) == dim, embedding).otherwise(fallback)


def unstacked(stack: Column, depth: int) -> Column:
    """The one embedding in a stack of arrays: depth 1 is itself, depth 2 the only row, depth 3 the only row of the only matrix; else null."""
    only = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    for _ in range(depth - 1):
        stack = only(stack)
    return stack


def perturbed(x: Column, weights: Column, epsilon: Column, snr: float) -> Column:
    """One step of at most epsilon against the sign of a linear score's gradient, within an SNR budget and within 1."""
    power = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
    step = F.least(epsilon, F.sqrt(power / F.pow(F.lit(10.0), F.lit(snr / 10.0))) * 0.999)
    return F.zip_with(x, weights, lambda v, w: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v - step * F.signum(w))))


def sign_steps(x: Column, weights: Column, bias: float, target: float, steps: Column) -> Column:
    """The smallest of the given step sizes at which moving each sample by its weight's sign takes a linear score past the target, else null."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, w: a + w)
    score, pull = total(F.zip_with(x, weights, lambda a, w: a * w)) + bias, total(F.transform(weights, F.abs))
    return F.array_min(F.filter(steps, lambda e: score - e * pull < target))
