"""Joins of times and segments. Every join has utt_id and a bucket of time as equal keys, so none becomes a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SEC = 10.0


def _near(end):
    """How far from the last end a time still counts as being there."""
    return F.lit(1e-8) + F.lit(1e-5) * F.abs(end)


def _bucket(t):
    return F.floor(t / BUCKET_SEC).cast("long")


def label_at(times: DataFrame, segments: DataFrame) -> DataFrame:
    """times(utt_id, t) with lang: of the first segment that holds t (start <= t < end; the last segment also holds its end, nearly)."""
    last = F.max("seg_id").over(Window.partitionBy("utt_id"))
    # a segment is listed under each bucket of time it touches
    spans = segments.withColumn("is_last", F.col("seg_id") == last).select("*", F.explode(F.sequence(_bucket(F.col("start")), _bucket(F.col("end") + _near(F.col("end"))))).alias("bucket"))
    asked = times.select("utt_id", "t").distinct().withColumn("bucket", _bucket(F.col("t")))
    near_end = F.col("is_last") & (F.abs(F.col("t") - F.col("end")) <= _near(F.col("end")))
    inside = ((F.col("start") <= F.col("t")) & (F.col("t") < F.col("end"))) | near_end
    found = asked.join(spans, ["utt_id", "bucket"]).where(inside).groupBy("utt_id", "t").agg(F.min_by("lang", "seg_id").alias("lang"))
    return times.join(found, ["utt_id", "t"], "left")


def boundary_cells(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """All distinct bounds of two segmentations, as cells between neighbours with their middle: (utt_id, start, end, t)."""
    bounds = None
    for df in (reference, predicted):
        for c in ("start", "end"):
            one = df.select("utt_id", F.col(c).alias("start"))
            bounds = one if bounds is None else bounds.unionByName(one)
    after = F.lead("start").over(Window.partitionBy("utt_id").orderBy("start"))
    cells = bounds.distinct().withColumn("end", after).where("end is not null and end > start")
    return cells.withColumn("t", (F.col("start") + F.col("end")) / 2)


def compared(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """The cells with both labels."""
    cells = boundary_cells(reference, predicted)
    ref = label_at(cells, reference).select("utt_id", "t", "start", "end", F.col("lang").alias("ref_lang"))
    return label_at(ref, predicted).withColumnRenamed("lang", "pred_lang")


def switching_accuracy(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """Share of the reference's time with the same label; time without a reference doesn't count, without a prediction it is wrong."""
    long = F.col("end") - F.col("start")
    cells = compared(reference, predicted).where("ref_lang is not null")
    hit = F.when(F.col("ref_lang").eqNullSafe(F.col("pred_lang")), long).otherwise(0.0)
    return cells.groupBy("utt_id").agg((F.sum(hit) / F.sum(long)).alias("accuracy"), F.sum(long).alias("seconds"))


def samples_of(segments: DataFrame, signals: DataFrame, rate: int, pad: float = 0.1, least: float = 0.3) -> DataFrame:
    """Each segment of at least `least` seconds with its samples, `pad` wider. signals(utt_id, x array<double>) joins by utt_id."""
    from ..functions.signal import seconds

    kept = segments.where(F.col("end") - F.col("start") >= least)
    return kept.join(signals, "utt_id").withColumn("x", seconds(F.col("x"), F.col("start"), F.col("end"), rate, pad))


def or_whole(segments: DataFrame, signals: DataFrame, rate: int, lang: str = "hi") -> DataFrame:
    """Segments, and one over the whole signal for each utterance that has none."""
    bare = signals.join(segments.select("utt_id").distinct(), "utt_id", "left_anti")
    whole = bare.select("utt_id", F.lit(0).alias("seg_id"), F.lit(0.0).alias("start"), (F.size("x") / F.lit(float(rate))).alias("end"), F.lit(lang).alias("lang"))
    return segments.select("utt_id", "seg_id", "start", "end", "lang").unionByName(whole)


def word_times(segments: DataFrame, text: str = "text", frames: str | None = None, carried: dict[str, Column] | None = None) -> DataFrame:
    """The words of a segment at even times, with the carried columns of their segment. Where a segment has no duration, `frames` (of 10 ms) give one of at most 30 s."""
    long = F.col("end") - F.col("start")
    if frames:
        long = F.when(long > 0, long).otherwise(F.least(F.col(frames) / 100, F.lit(30.0)))
    more = carried or {}
    words = segments.select("utt_id", "seg_id", *(c.alias(name) for name, c in more.items()), "start", long.alias("long"), F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("words"))
    rows = words.select("utt_id", "seg_id", *more, "start", (F.col("long") / F.size("words")).alias("step"), F.posexplode("words").alias("pos", "word"))
    return rows.select("utt_id", "seg_id", "pos", "word", (F.col("start") + F.col("pos") * F.col("step")).alias("word_start"), (F.col("start") + (F.col("pos") + 1) * F.col("step")).alias("word_end"), *more)


def deduplicated_words(words: DataFrame) -> DataFrame:
    """words(utt_id, word_start, word_end, word, ...): a word goes if the last kept one has the same text and overlaps more than half of it.

    What is dropped has the text of the last kept one, so a word of another text than its neighbour's is always kept: the rule is applied within runs of
    one text, each a group of its own and a fold that remembers the last kept word.
    """
    order = Window.partitionBy("utt_id").orderBy("word_start", "seg_id", "pos", "word_end", "word")
    fresh = F.when(F.lag(F.lower("word")).over(order) == F.lower("word"), 0).otherwise(1)
    entry = F.struct("word_start", F.col("seg_id"), F.col("pos"), "word_end", "word")
    runs = words.withColumn("run", F.sum(fresh).over(order)).groupBy("utt_id", "run").agg(F.array_sort(F.collect_list(entry)).alias("all"))  # one word said again and again
    kind = "array<struct<word_start:double,seg_id:int,pos:int,word_end:double,word:string>>"

    def step(kept, w):
        last = F.try_element_at(kept, F.lit(-1))
        overlap = F.least(last["word_end"], w["word_end"]) - F.greatest(last["word_start"], w["word_start"])
        own = w["word_end"] - w["word_start"]
        return F.when(F.coalesce(last.isNotNull() & (own > 0) & (overlap / own > 0.5), F.lit(False)), kept).otherwise(F.concat(kept, F.array(w)))

    kept = F.when(F.size("all") == 1, F.col("all").cast(kind)).otherwise(F.aggregate(F.col("all").cast(kind), F.array().cast(kind), step))
    return runs.select("utt_id", F.explode(kept).alias("w")).select("utt_id", "w.*")


def switch_text(segments: DataFrame, text: str = "text", mark: str = " ‖ ") -> DataFrame:
    """The texts of an utterance in order; a mark where the label of neighbours with text differs."""
    kept = segments.where(F.trim(F.col(text)) != "")
    order = Window.partitionBy("utt_id").orderBy("seg_id")
    before = F.lag("lang").over(order)
    lead = F.when(before.isNull(), "").when(before != F.col("lang"), mark).otherwise(" ")
    parts = kept.select("utt_id", "seg_id", F.concat(lead, F.trim(F.col(text))).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("seg_id", "part")))
    return parts.groupBy("utt_id").agg(F.array_join(F.transform(ordered, lambda s: s["part"]), "").alias("full_text"))
