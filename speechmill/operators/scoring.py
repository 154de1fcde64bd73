"""Detection and recognition scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Points of a curve, and ranges of an order, that one task sorts at once.
BLOCK, RANGES = 4096, 1024


def roc(scores: DataFrame, buckets: int = 64) -> DataFrame:
    """scores(label 0/1, score) to the points of the ROC, a row per distinct score from the highest down: k, score, fpr, tpr.

    Running counts in two steps: sums of ranges of the score, then within a range, so no task holds all distinct scores.
    """
    ties = scores.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    cut = ties.agg(F.expr(f"percentile_approx(score, array({','.join(str(i / buckets) for i in range(1, buckets))}))").alias("cuts"))  # one row
    ties = ties.crossJoin(F.broadcast(cut)).withColumn("bucket", F.size(F.filter("cuts", lambda c: c > F.col("score")))).drop("cuts")
    sums = ties.groupBy("bucket").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"), F.count("*").alias("sk"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    sums = sums.select("bucket", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b{c}") for c in ("sp", "sn", "sk")))
    totals = ties.agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))  # one row
    within = Window.partitionBy("bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ties.join(F.broadcast(sums), "bucket").crossJoin(F.broadcast(totals))
    return rows.select(
        (F.col("bsk") + F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("score")))).alias("k"), "score",
        ((F.col("bsn") + F.sum("n").over(within)) / F.col("tn")).alias("fpr"), ((F.col("bsp") + F.sum("p").over(within)) / F.col("tp")).alias("tpr"),
        (F.col("bsn") + F.sum("n").over(within)).alias("fp"), (F.col("bsp") + F.sum("p").over(within)).alias("tp_n"),
    )


def equal_error_rate(scores: DataFrame) -> DataFrame:
    """eer, threshold: mean of the two error rates where they are closest; the first such point. Inner points of straight runs don't count."""
    points = roc(scores)
    # blocks of neighbours; the points at the edges of a block also go to the next one, so no task orders all points
    block = lambda k: F.floor(k / BLOCK)
    k = F.col("k")
    points = points.withColumn("block", F.explode(F.array_distinct(F.array(block(k - 1), block(k), block(k + 1)))))
    around = Window.partitionBy("block").orderBy("k")
    second = lambda c: F.lead(c).over(around) - 2 * F.col(c) + F.coalesce(F.lag(c).over(around), F.lit(0))
    bend = points.withColumn("straight", (second("fp") == 0) & (second("tp_n") == 0))
    bend = bend.where(F.col("block") == block(k))
    kept = bend.where(F.coalesce(~F.col("straight"), F.lit(True))).select("k", "score", "fpr", "tpr")
    start = points.sparkSession.createDataFrame([(0, None, 0.0, 0.0)], "k long, score double, fpr double, tpr double")
    fnr = 1 - F.col("tpr")
    best = start.unionByName(kept).select(F.abs(fnr - F.col("fpr")).alias("gap"), "k", "score", ((fnr + F.col("fpr")) / 2).alias("eer"))
    return best.agg(F.min(F.struct("gap", "k", "eer", "score")).alias("b")).select("b.eer", F.col("b.score").alias("threshold"))


def accuracy_and_loss(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scores(label, p): share right at the threshold and mean log loss."""
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("p")))
    loss = -(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
    right = F.when((F.col("p") >= threshold) == (F.col("label") == 1), 1.0).otherwise(0.0)
    return scores.agg(F.avg(right).alias("accuracy"), F.avg(loss).alias("loss"), F.count("*").alias("n"))


def decision(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, "bona_fide").otherwise("spoof")


def stratified_split(rows: DataFrame, label: str, order: str, train_share: float = 0.75) -> DataFrame:
    """rows with `part`: of each label the first share in order (a number) trains (rounded half to even, at least 1, at most all but one); a lone row is in both. An error where there is only one label.

    The place within a label is counted in even ranges of the order first, so a label that has most rows isn't one task's.
    """
    o = F.col(order).cast("double")
    sized = rows.groupBy(label).agg(F.count("*").alias("size"), F.min(o).alias("low"), F.max(o).alias("high"))
    both = sized.agg(F.count("*").alias("labels"))  # one row
    cut = F.greatest(F.lit(1), F.least(F.bround(F.col("size") * train_share, 0).cast("long"), F.col("size") - 1))
    sized = sized.crossJoin(F.broadcast(both)).withColumn("cut", F.when(F.col("labels") < 2, F.raise_error(F.lit("a split needs rows of both labels"))).otherwise(cut))
    place = F.least(F.lit(RANGES - 1), F.floor((o - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * RANGES))
    ranged = rows.join(sized, label).withColumn("range_id", place)
    before = F.coalesce(F.sum("c").over(Window.partitionBy(label).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy(label, "range_id").agg(F.count("*").alias("c")).select(label, "range_id", before.alias("offset"))
    nth = F.col("offset") + F.row_number().over(Window.partitionBy(label, "range_id").orderBy(order))
    placed = ranged.join(offsets, [label, "range_id"]).withColumn("place", nth)
    part = F.when(F.col("size") == 1, F.array(F.lit("train"), F.lit("val"))).when(F.col("place") <= F.col("cut"), F.array(F.lit("train"))).otherwise(F.array(F.lit("val")))
    return placed.select(*rows.columns, F.explode(part).alias("part"))


def word_error_rate(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """pairs with edits, n_words (of the reference) and wer. Each distinct word of a pair becomes one character, so the built-in edit distance counts words.

    Words and their list are columns of steps of their own: what a lambda holds is worked out again for each element.
    """
    cut = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")
    rows = pairs.withColumns({"words_a": cut(reference), "words_b": cut(hypothesis)})
    rows = rows.withColumn("words_known", F.array_distinct(F.concat("words_a", "words_b")))
    coded = lambda ws: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position("words_known", w) + 19967), 4, "0")), "UTF-16BE")), "")
    rows = rows.withColumns({"edits": F.levenshtein(coded("words_a"), coded("words_b")), "n_words": F.size("words_a")})
    return rows.drop("words_a", "words_b", "words_known").withColumn("wer", F.when(F.col("n_words") > 0, F.col("edits") / F.col("n_words")))


def snr_estimate(powers: DataFrame) -> DataFrame:
    """powers(utt_id, power): 10 log10 of the 95th over the 5th percentile, which gets 1e-12 more; 0 without powers, minus infinity for silence."""
    p = lambda q: F.percentile("power", F.lit(q))
    ratio = p(0.95) / (p(0.05) + F.lit(1e-12))
    return powers.groupBy("utt_id").agg(F.when(ratio.isNull(), 0.0).when(ratio <= 0, F.lit(float("-inf"))).otherwise(F.lit(10.0) * F.log10(ratio)).alias("snr_db"))


def metric_bundle(spark, **metrics: DataFrame | None) -> DataFrame:
    """One row of metrics, each the only value of a one-row DataFrame, or null where it couldn't be had."""
    rows = spark.createDataFrame([], "name string, value double")
    for name, df in metrics.items():
        if df is not None:
            rows = rows.unionByName(df.toDF("value").select(F.lit(name).alias("name"), F.col("value").cast("double").alias("value")))
    # no broadcast of a metric, which would have to be there within spark.sql.broadcastTimeout
    return rows.agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in metrics))
