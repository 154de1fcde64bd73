"""Send this package to the executors of a session, so functions that run there find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """addPyFile of the package, once for each application; not needed where PYTHONPATH already has it."""
    home = Path(__file__).resolve().parent
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(home.parent) not in known and app not in _sent:
        path = os.path.join(tempfile.mkdtemp(prefix="speechmill-"), "speechmill.zip")
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(home.rglob("*.py")):
                out.write(p, p.relative_to(home.parent))
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark
