"""The queries of this folder by name, each with its SQL where SQL can express it, and the tables that stand in for speech inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir)."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in the partitions that Spark's own settings (spark.sql.files.maxPartitionBytes, minPartitionNum) cut its files into."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, places) + F.lit(0.0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt_id, frame_idx, start, end, prob_hi, prob_en, lang, event: a user's events in order are the frames of an utterance."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("utt_id"), place.alias("frame_idx"), (F.col("value") / (1 + F.col("value"))).alias("prob_hi"), F.col("event_type").alias("event"))
    start = F.col("frame_idx") * F.lit(0.1)
    return rows.select("utt_id", "frame_idx", start.alias("start"), (start + F.lit(0.5)).alias("end"), "prob_hi", (1 - F.col("prob_hi")).alias("prob_en"), F.when(F.col("prob_hi") >= 0.95, "hi").otherwise("en").alias("lang"), "event")


FRAMES = """frames AS (SELECT *, frame_idx * 0.1::DOUBLE AS start, frame_idx * 0.1::DOUBLE + 0.5::DOUBLE AS "end", 1 - prob_hi AS prob_en, CASE WHEN prob_hi >= 0.95::DOUBLE THEN 'hi' ELSE 'en' END AS lang
  FROM (SELECT user_id AS utt_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx, value / (1 + value) AS prob_hi, event_type AS event FROM events))"""


def run_sql(source: str, label: str, name: str) -> str:
    """Common table expressions: the runs of a label of frames."""
    return f"""{name}_marked AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY utt_id ORDER BY frame_idx) - 1 AS INTEGER) AS seg_id
  FROM (SELECT *, CASE WHEN lag({label}) OVER (PARTITION BY utt_id ORDER BY frame_idx) IS NOT DISTINCT FROM {label} THEN 0 ELSE 1 END AS fresh FROM {source})),
{name}_runs AS (SELECT utt_id, seg_id, min(start) AS start, arg_max("end", frame_idx) AS last_end, any_value({label}) AS lang, count(*) AS n_frames FROM {name}_marked GROUP BY utt_id, seg_id),
{name} AS (SELECT utt_id, seg_id, start, coalesce(lead(start) OVER (PARTITION BY utt_id ORDER BY seg_id), last_end) AS "end", lang, n_frames FROM {name}_runs)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x array<double>: an embedding is a short signal."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


SIGNALS = """s AS (SELECT *, len(x) AS n, list_sum(list_transform(x, lambda v: v * v)) AS e, list_max(list_transform(x, lambda v: abs(v))) AS p
  FROM (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings))"""
