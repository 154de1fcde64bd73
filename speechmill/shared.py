"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The setting by which a query's shuffle files go when it ends, not when the driver next collects garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the checkpoint folder set on its context.

    Where neither is set, as in tests, a local session gets a folder of its own; on a cluster such a folder would be lost with its machine, so there it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='speechmill-')}")
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = held.get()
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/speechmill/{uuid.uuid4().hex[:12]}-{name}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: read many times, computed once, and kept when executors are lost. Shuffle files are deleted once their query has
    ended; the session's setting for that is turned on and stays on."""
    path = new_path(df.sparkSession, name)
    df.sparkSession.conf.set(RELEASE, "true")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batch, rows: int = 64):
    """An Arrow batch in slices of a few rows, so that what is held as Python objects doesn't grow with the batch."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
