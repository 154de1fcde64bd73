"""Exact deduplication as a stateful stream with disk-backed state.

The documents' digests land as a narrow table; a structured stream reads it and keeps, for each digest and length, the
smallest doc_id with its content locator (file and place of the row) and the number of rows. The state lives in RocksDB, has no
watermark and never expires, so a later run of the stream with the same checkpoint goes on where this one ended. Rows are
aggregated in the tasks before the shuffle, so a text that a third of all rows share arrives as a row per task.

Hits (digests with more than one row) are checked by full bytes: the locator in the state leads to the content of the row
that stays, and each hit's normalised text is compared with it. Rows that differ (clashes of the digest) are grouped by the
full text instead. Texts of rows that aren't hits are not shuffled but for the false hits of bitmaps
of their locators (6 % of rows at most up to 1e9 hits, more beyond 4e9: see common.Marks).

Defined results: null text is empty; texts are equal when identical after each run of blanks is one space; of rows that repeat one
doc_id with one text exactly one is kept, the first by its locator; null doc_ids come last, as they can't be smallest unless alone; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, Marks, located, new_path, stored, without_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of one group that a keeper's text is sent to at once; larger groups are split.
SALT_ROWS = 256
#: Split groups also have this share of all rows: there can't be more than its inverse of them, and their narrow list goes to all tasks.
HOT_SHARE = 1e-5
FILES_PER_BATCH = 1000
KEYS = ["digest", "n_bytes"]


def _rank() -> Column:
    """The row that stays is the least by this: a null id sorts last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{BLANK}+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.streaming.stateStore.providerClass"
    options = {"changelogCheckpointing.enabled": "true", "allowFAllocate": "false", "trackTotalNumberOfRows": "false"}  # many small stores: no space set aside, no reads for a row count
    wanted = {key: ROCKSDB} | {f"spark.sql.streaming.stateStore.rocksdb.{k}": v for k, v in options.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def landed(docs: DataFrame, at: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, digest, n_bytes, at (the locator); with another digest than SHA-256 also sha."""
    text = normalised(docs["text"])
    more = [] if digest is sha256 else [sha256(text).alias("sha")]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), digest(text).alias("digest"), F.octet_length(text).alias("n_bytes"), at.alias("at"), *more)


def run_stream(spark: SparkSession, path: str, schema, checkpoint: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Take in what is new under path; gives the state: digest, n_bytes, first (doc_id, at), copies."""
    with _rocksdb(spark):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        state = rows.groupBy("digest", "n_bytes").agg(F.min(_rank()).alias("first"), F.count("*").alias("copies"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        held = spark.read.format("statestore").load(checkpoint)
    value = held.schema["value"].dataType.fieldNames()
    return held.select("key.digest", "key.n_bytes", F.col(f"value.`{value[0]}`").alias("first"), F.col(f"value.`{value[1]}`").alias("copies"))


def _checked(docs: DataFrame, at: Column, hits: DataFrame, multi: DataFrame, hot: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, at, digest, n_bytes, first, copies, sha of each hit, and `other`: its text where it isn't that of the row that stays."""
    text = normalised(docs["text"])
    # the content of the rows that stay, by their locators
    keepers = multi.select(*KEYS, "first", "copies")
    may, _ = Marks(keepers, F.col("first.at"), keepers.count()).split(docs, at, [docs["text"], at.alias("at")])
    keepers = keepers.join(may.select("at", normalised(F.col("text")).alias("kept_text")).hint("merge"), F.col("first.at") == F.col("at")).drop("at")
    parts = F.greatest(F.lit(1), F.ceil(F.col("copies") / SALT_ROWS)).cast("long")
    keepers = keepers.join(F.broadcast(hot.select(*KEYS, F.lit(True).alias("hot"))), KEYS, "left")
    keepers = keepers.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.lit(0).cast("long"))))).drop("hot")
    # the hits' own texts
    may, _ = Marks(hits, F.col("at"), hits.count()).split(docs, at, [docs["doc_id"].cast("long").alias("doc_id"), text.alias("norm"), at.alias("at")])
    may = may.withColumns({"digest": digest(F.col("norm")), "n_bytes": F.octet_length("norm")})
    may = may.join(F.broadcast(hot.select(*KEYS, parts.alias("parts"))), KEYS, "left").withColumn("salt", F.pmod(F.xxhash64("at"), F.coalesce("parts", F.lit(1)))).drop("parts")
    both = may.join(keepers.hint("merge"), [*KEYS, "salt"])
    same = F.col("norm") == F.col("kept_text")
    sha = F.col("digest") if digest is sha256 else sha256(F.col("norm"))
    return both.select("doc_id", "at", *KEYS, "first", "copies", sha.alias("sha"), F.when(~same, F.col("norm")).alias("other"))


def _judged(docs: DataFrame, at: Column, digest: Callable[[Column], Column], files_per_batch: int) -> DataFrame:
    """doc_id, at, first (of its group), copies, sha: a row for each row of docs."""
    spark = docs.sparkSession
    land = landed(docs, at, digest)
    path = new_path(spark, "landed")
    land.write.parquet(path)
    land = spark.read.schema(land.schema).parquet(path)
    sha = F.col("digest") if digest is sha256 else F.col("sha")
    alone = land.select("doc_id", "at", _rank().alias("first"), F.lit(1).cast("long").alias("copies"), sha.alias("sha"))
    total = land.count()
    if not total:
        return alone
    state = run_stream(spark, path, land.schema, new_path(spark, "dedup-state"), files_per_batch)
    multi = stored(state.where("copies > 1"), "groups")
    hot = multi.where(F.col("copies") > max(SALT_ROWS, int(total * HOT_SHARE))).select(*KEYS, "copies")  # at most 1 / HOT_SHARE narrow rows

    rest = land.join(F.broadcast(hot), KEYS, "left_anti")
    few = multi.join(F.broadcast(hot), KEYS, "left_anti").select(*KEYS)
    hits = land.join(F.broadcast(hot), KEYS, "left_semi").select("at").unionByName(rest.join(few.hint("merge"), KEYS, "left_semi").select("at"))
    checked = stored(_checked(docs, at, stored(hits, "hits"), multi, hot, digest), "checked", compression="zstd")
    single = rest.join(few.hint("merge"), KEYS, "left_anti").select("doc_id", "at", _rank().alias("first"), F.lit(1).cast("long").alias("copies"), sha.alias("sha"))
    groups = checked
    if not checked.where("other is not null").isEmpty():
        # clashes: what differs from the row that stays is grouped by full text
        part = Window.partitionBy(*KEYS, "other")
        groups = checked.withColumns({"copies": F.count("*").over(part), "first": F.min(_rank()).over(part)})
    return single.unionByName(groups.select("doc_id", "at", "first", "copies", "sha"))


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs."""
    found = _judged(*located(docs), digest, files_per_batch)
    return found.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("copies").alias("group_size"), (F.col("at") == F.col("first.at")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, columns as they are.

    Rows go by their locator, so it matters neither that doc_ids repeat nor that they are null: of null ones with an equal text one stays.
    Null texts are empty ones; an empty table stays empty; columns of any name are kept.
    """
    docs, at = located(docs)
    found = _judged(docs, at, sha256, FILES_PER_BATCH)
    return without_rows(docs, at, found.where(F.col("at") != F.col("first.at")).select("at"))
