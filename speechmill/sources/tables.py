"""Text, JSON, curves and manifests, written and read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentences

SEGMENTS = "array<struct<seg_id:int,start:double,end:double,lang:string>>"


def write_text(lines: DataFrame, path: str, column: str = "text") -> str:
    """One line for each row; what was there goes."""
    lines.select(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)
    return path


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """text: a row for each line, or for each file."""
    return spark.read.text(path, wholetext=whole).withColumnRenamed("value", "text")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """sentence: of each line of a corpus."""
    return read_text(spark, path).select(F.explode(sentences(F.col("text"))).alias("sentence"))


def write_segments(segments: DataFrame, path: str) -> str:
    """A JSON line for each utterance with its segments in order."""
    listed = F.array_sort(F.collect_list(F.struct("seg_id", "start", "end", "lang")))  # the segments of one utterance
    segments.groupBy("utt_id").agg(listed.alias("segments")).write.mode("overwrite").json(path)
    return path


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"utt_id long, segments {SEGMENTS}").json(path)
    return rows.select("utt_id", F.explode("segments").alias("s")).select("utt_id", "s.*")


def write_curves(curves: DataFrame, path: str) -> str:
    """Curves as array columns, compressed."""
    curves.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def manifest(**artifacts: tuple[DataFrame, str]) -> DataFrame:
    """name, path, n_rows of each output; counted from what was written."""
    out = None
    for name, (df, path) in artifacts.items():
        one = df.agg(F.lit(name).alias("name"), F.lit(path).alias("path"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def as_json(*columns: Column) -> Column:
    """One JSON object of the given columns."""
    return F.to_json(F.struct(*columns))


def dump(full_text: Column, duration: Column, words: Column) -> Column:
    """A transcript for people: words are structs (word, start, end, lang, confidence)."""
    line = lambda w: F.format_string("  %6.2fs – %6.2fs  [%s]  '%s'  (conf=%.3f)", w["start"], w["end"], w["lang"], w["word"], w["confidence"])
    head = F.format_string("[Full transcript]\n%s\n\n[Duration] %.2fs\n\n[Word-level timestamps]", full_text, duration)
    return F.concat_ws("\n", head, F.array_join(F.transform(words, line), "\n"))
