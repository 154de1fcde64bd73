"""The entry module works without the folders that may be taken away."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "speechmill", tmp_path / "speechmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(x.startswith('op1') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.columns == ["utt_id", "seg_id", "start", "end", "lang"] and rows.count() > 0
