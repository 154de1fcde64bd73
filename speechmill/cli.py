"""Run one query over a folder of tables and write its rows: python -m speechmill.cli QUERY --input DIR --output DIR."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import QUERIES


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="speechmill", description="Speech analytics on Spark.")
    out.add_argument("query", choices=sorted(QUERIES), metavar="QUERY", help="a query of speechmill.plans")
    out.add_argument("--input", required=True, help="folder of the Parquet tables")
    out.add_argument("--output", required=True, help="where the rows go; what is there is replaced")
    out.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
    out.add_argument("--master", help="a Spark master; else the one Spark is configured with")
    return out


def main(arguments: Sequence[str] | None = None) -> None:
    own = parser().parse_args(arguments)
    builder = SparkSession.builder.appName(f"speechmill-{own.query}").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(own.master) if own.master else builder).getOrCreate()
    QUERIES[own.query](spark, own.input).write.mode("overwrite").format(own.format).save(own.output)


if __name__ == "__main__":
    main()
