"""Frames to segments: smoothing, run lengths, refinement. Frames are rows (utt_id, frame_idx, ...), so a long utterance is many rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WINDOW_SEC, HOP_SEC, LEAST_SEC = 0.5, 0.1, 0.2


def binary_probabilities(hi: Column, en: Column) -> tuple[Column, Column, Column]:
    """Two scores to shares that sum to one, and the label; equal scores are hi."""
    total = hi + en + F.lit(1e-12)
    return hi / total, en / total, F.when(hi / total >= en / total, "hi").otherwise("en")


def gaussian_weights(window: int) -> list[float]:
    import math

    size = window if window % 2 else window + 1
    half = size // 2
    sigma = half / 2 or 1.0
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def _mirrored(frames: DataFrame, value: Column, half: int, edge: bool, name: str, of: Callable[[Callable[[int], Column]], Column]) -> DataFrame:
    """(utt_id, frame_idx, name): `of` makes a column from at(k), the value k places away, mirrored at the ends (edge: the last value is repeated first).

    One sort by frame gives all of it. Frames of utterances shorter than half meet more than one mirror, so the place is
    computed; it never lies farther away than 2 * half places.
    """
    by = Window.partitionBy("utt_id").orderBy("frame_idx")
    whole = Window.partitionBy("utt_id").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(by) - 1, F.count("*").over(whole)
    near = {k: F.lag(value, -k).over(by) for k in range(-2 * half, 2 * half + 1)}
    rows = frames.select("utt_id", "frame_idx", i.alias("i"), n.alias("n"), *(c.alias(f"v{k + 2 * half}") for k, c in near.items()))

    def at(k: int) -> Column:
        place, size = F.col("i") + k, F.col("n").cast("int")
        if edge:
            r = F.pmod(place, size * 2)
            target = F.when(r < size, r).otherwise(size * 2 - 1 - r)
        else:
            period = F.greatest(size * 2 - 2, F.lit(1))
            r = F.pmod(place, period)
            target = F.when(size == 1, F.lit(0)).when(r < size, r).otherwise(period - r)
        return F.element_at(F.array(*(F.col(f"v{j}") for j in range(4 * half + 1))), target - F.col("i") + 2 * half + 1)

    return rows.select("utt_id", "frame_idx", of(at).alias(name))


def gaussian_smoothed(frames: DataFrame, value: str = "prob_hi", window: int = 7) -> DataFrame:
    """(utt_id, frame_idx, smooth): Gaussian moving average over mirrored ends (the last value isn't repeated)."""
    w = gaussian_weights(window)
    half = len(w) // 2
    return _mirrored(frames, F.col(value), half, False, "smooth", lambda at: reduce(Column.__add__, [F.lit(x) * at(k - half) for k, x in enumerate(w)]))


def median_labels(frames: DataFrame, label: str = "lang", kernel: int = 5, one: str = "en", zero: str = "hi") -> DataFrame:
    """(utt_id, frame_idx, label): the more frequent of two labels around a frame, over mirrored ends with the last value repeated."""
    half = (kernel if kernel % 2 else kernel + 1) // 2
    vote = F.when(F.col(label) == one, 1).otherwise(0)
    return _mirrored(frames, vote, half, True, label, lambda at: F.when(reduce(Column.__add__, [at(k) for k in range(-half, half + 1)]) > half, one).otherwise(zero))


def runs(frames: DataFrame, label: str = "lang") -> DataFrame:
    """frames(utt_id, frame_idx, start, end, label) to segments: a run ends where the next begins, the last one at its last frame's end."""
    by_frame = Window.partitionBy("utt_id").orderBy("frame_idx")
    changed = F.lag(label).over(by_frame)
    marked = frames.withColumn("new", F.when(changed.isNull() | (changed != F.col(label)), 1).otherwise(0)).withColumn("seg_id", F.sum("new").over(by_frame) - 1)
    grouped = marked.groupBy("utt_id", "seg_id").agg(F.min("start").alias("start"), F.max_by("end", "frame_idx").alias("end"), F.first(label).alias("lang"), F.count("*").alias("n_frames"))
    after = F.lead("start").over(Window.partitionBy("utt_id").orderBy("seg_id"))
    return grouped.select("utt_id", F.col("seg_id").cast("int").alias("seg_id"), "start", F.coalesce(after, "end").alias("end"), "lang", "n_frames")


def _contracted(segments: DataFrame, joins: Column, *more: Column) -> DataFrame:
    """Each segment for which `joins` holds becomes part of the one before it, which keeps its start and label. Segments are numbered anew."""
    run = F.sum(F.when(joins, 0).otherwise(1)).over(_order())
    marked = segments.withColumn("run", run)
    grouped = marked.groupBy("utt_id", "run").agg(F.min_by("start", "seg_id").alias("start"), F.max_by("end", "seg_id").alias("end"), F.min_by("lang", "seg_id").alias("lang"), *more)
    return grouped.select("utt_id", (F.dense_rank().over(Window.partitionBy("utt_id").orderBy("run")) - 1).alias("seg_id"), *(c for c in grouped.columns if c not in ("utt_id", "run")))


def _order() -> WindowSpec:
    return Window.partitionBy("utt_id").orderBy("seg_id")


def _before() -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _equal_before() -> Column:
    return F.coalesce(F.lag("lang").over(_order()) == F.col("lang"), F.lit(False))


def merged(segments: DataFrame) -> DataFrame:
    """Neighbours of one label become one segment."""
    rows = segments.withColumn("equal", _equal_before())
    return _contracted(rows, F.col("equal"), F.sum("n_frames").alias("n_frames"))


def _last(value: Column | str, window: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(window)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def short_absorbed(segments: DataFrame, least: float) -> DataFrame:
    """Segments under `least` widen a neighbour: the longer one, the one before if equal, where the one before counts as wide as it is by then.

    What is at least that long stays. Before the first that does, everything goes forward, until what has gathered is long enough. Between two that stay,
    the one before is always longer than a short one that follows, so all short ones but the last go back. The last goes on if the one before it is
    narrower than the next, which depends on whether that one was itself widened backwards: a width more can only turn `on` into `back`. So each gap
    has a fixed answer or the opposite of the gap before, and the answers are the last fixed one and the parity of the changes since.
    """
    long = lambda: F.col("end") - F.col("start")
    rows = segments.withColumns({"reaches": (F.col("end") - F.first("start").over(_order()) >= least) | F.lead(F.lit(1)).over(_order()).isNull(), "end_before": F.lag("end").over(_order())})
    rows = rows.withColumn("reached", F.coalesce(F.max("reaches").over(_before()), F.lit(False)))
    rows = rows.withColumn("stays", F.when(F.col("reached"), long() >= least).otherwise(F.col("reaches")))
    rows = rows.withColumn("own", F.greatest(F.sum(F.col("stays").cast("long")).over(_order()), F.lit(1)))
    stays = lambda c: F.max(F.when(F.col("stays"), c))
    gaps = rows.groupBy("utt_id", "own").agg(
        F.min_by("start", "seg_id").alias("start"), stays(F.col("lang")).alias("lang"), stays(long()).alias("width"), F.max(F.when(F.col("reached") & ~F.col("stays"), True)).alias("gap"),
        F.max_by("start", "seg_id").alias("tail"), F.max_by("end", "seg_id").alias("end"), F.max_by("end_before", "seg_id").alias("end_before"),
    )
    order = Window.partitionBy("utt_id").orderBy("own")
    goes_on = lambda start: _sure(F.col("gap") & ~(F.col("end_before") - start >= F.lead("width").over(order)))
    gaps = gaps.withColumn("tail_before", F.lag("tail").over(order))
    gaps = gaps.withColumns({"on": goes_on(F.col("start")), "on_if_wider": goes_on(F.coalesce("tail_before", "start"))})
    gaps = gaps.withColumn("turns", F.sum((F.col("on") != F.col("on_if_wider")).cast("long")).over(order))
    fixed = F.col("on") == F.col("on_if_wider")
    gaps = gaps.withColumn("on", (_last(F.when(fixed, F.col("on").cast("long") - F.col("turns")), order) + F.col("turns")) % 2 != 0)
    wider = F.coalesce(F.lag("on").over(order), F.lit(False))
    return gaps.select("utt_id", F.col("own").alias("seg_id"), F.when(wider, F.col("tail_before")).otherwise(F.col("start")).alias("start"), F.when(F.col("on"), F.col("end_before")).otherwise(F.col("end")).alias("end"), "lang")


def flicker_dropped(segments: DataFrame, least: float) -> DataFrame:
    """Three segments a b a whose middle is under `least` become one, until there are no such three. Neighbours have different labels, and none is
    under half of `least`.

    The first sweep takes such threes from the left, each after the one before. In a run of places that begin such a three, every third is taken,
    from the first or, if the last three of the run before reaches into it, from the second. It can only where one place lies between them, and
    does so if the run before, less what reaches into it, has one place more than a multiple of three: a run of 3k + 1 places turns the answer round, one of
    3k + 2 hands it on, one of 3k ends it. After it a three is left only where its first is one that was taken, and what was taken is too
    long to be a middle; so the threes that are left meet only at their ends, and each chain of them becomes one.
    """
    middle = F.lead("end").over(_order()) - F.lead("start").over(_order())
    rows = segments.withColumns({"begins": _sure((F.lead("lang", 2).over(_order()) == F.col("lang")) & (middle < least)), "i": F.row_number().over(_order())})
    rows = rows.withColumn("i_before", _last(F.when(F.col("begins"), F.col("i")), _before()))
    rows = rows.withColumn("opens", F.col("begins") & F.coalesce(F.col("i") - F.col("i_before") > 1, F.lit(True)))
    opened = F.when(F.col("opens"), F.col("i"))
    rows = rows.withColumns({"first": _last(opened, _order()), "first_before": _last(opened, _before())})
    places = (F.col("i_before") - F.col("first_before") + 1) % 3
    near = F.col("opens") & _sure(F.col("i") - F.col("i_before") == 2)
    rows = rows.withColumns({"turns": F.sum((near & (places == 1)).cast("long")).over(_order()), "fresh": F.col("opens") & ~(near & (places != 0))})
    skipped = (F.col("turns") - _last(F.when(F.col("fresh"), F.col("turns")), _order())) % 2
    rows = rows.withColumn("place", F.col("i") - F.col("first") - skipped)
    rows = rows.withColumn("taken", _sure(F.col("begins") & (F.col("place") >= 0) & (F.col("place") % 3 == 0)))
    rows = rows.withColumn("joins", F.lag("taken", 1, False).over(_order()) | F.lag("taken", 2, False).over(_order()))
    rows = _contracted(rows, F.col("joins"))
    rows = rows.withColumn("middle", _sure((F.lag("lang").over(_order()) == F.lead("lang").over(_order())) & (F.col("end") - F.col("start") < least)))
    rows = rows.withColumn("joins", F.col("middle") | F.lag("middle", 1, False).over(_order()))
    return _contracted(rows, F.col("joins"))


def to_places(x: Column, places: int = 3) -> Column:
    """x to so many decimal places as its exact binary value rounds, ties to even: 1.0005, a little under the tie, becomes 1.0."""
    scale = 10.0**places
    a = F.abs(x)
    n = F.floor(a * scale)
    # 2 * scale * a - (2 n + 1) without rounding: a in two parts of 26 bits, whose products are exact
    high = a * 134217729.0 - (a * 134217729.0 - a)
    over = (high * (2 * scale) - (2 * n + 1)) + (a - high) * (2 * scale)
    up = (over > 0) | ((over == 0) & (n % 2 == 1))
    return F.signum(x) * F.when(up, n + 1).otherwise(n) / F.lit(scale)


def refined(segments: DataFrame, least: float = LEAST_SEC) -> DataFrame:
    """Short segments absorbed, equal neighbours merged, flicker dropped, times to 3 places.

    Each step is a fixed number of windows and groupings by utterance over segments as rows: no loop, and no array that grows with an utterance.
    """
    rows = segments.select("utt_id", "seg_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "lang")
    rows = short_absorbed(rows, least).withColumn("equal", _equal_before())
    out = flicker_dropped(_contracted(rows, F.col("equal")), 2 * least)
    return out.select("utt_id", F.col("seg_id").cast("int").alias("seg_id"), to_places(F.col("start")).alias("start"), to_places(F.col("end")).alias("end"), "lang")


def utterance_probabilities(frames: DataFrame) -> DataFrame:
    """Means of the frames' probabilities, to sum one, with the label."""
    means = frames.groupBy("utt_id").agg(F.avg("prob_hi").alias("hi"), F.avg("prob_en").alias("en"))
    hi, en, label = binary_probabilities(F.col("hi"), F.col("en"))
    return means.select("utt_id", hi.alias("prob_hi"), en.alias("prob_en"), label.alias("lang"))


def zscores(rows: DataFrame, value: str, key: str = "utt_id") -> DataFrame:
    """Population z-scores by key; constant groups become 0."""
    by = Window.partitionBy(key)
    std = F.stddev_pop(value).over(by)
    return rows.withColumn("z", F.when(std < 1e-8, 0.0).otherwise((F.col(value) - F.avg(value).over(by)) / std))


def forward_filled(rows: DataFrame, value: str, order: str, key: str = "utt_id", source: str | None = None) -> DataFrame:
    """Missing values take the last one before, 0 at the start; if all are about 0, the mean of the source curve (its column; else of what was there)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("filled", F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0.0)))
    by = Window.partitionBy(key)
    flat = F.max(F.abs("filled")).over(by) < 1e-8
    return filled.withColumn("filled", F.when(flat, F.coalesce(F.avg(source or value).over(by), F.lit(0.0))).otherwise(F.col("filled")))
