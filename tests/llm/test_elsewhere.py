"""Queries started from a folder where the workers can't import the package."""

import os
import subprocess
import sys
from pathlib import Path

from conftest import TESTDATA

CODE = """
import importlib.util, sys
from pyspark.sql import SparkSession

spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": sys.argv[3], "spark.ui.showConsoleProgress": "false"}
builder = SparkSession.builder.master("local[4]")
for k, v in conf.items():
    builder = builder.config(k, v)
spark = builder.getOrCreate()
for name in ("op5_language_id", "op6_neighbours", "op13_conversations", "logistic_by_group"):
    print(name, entry.queries()[name](spark, sys.argv[2]).count())
"""


def test_queries_run_from_another_folder(tmp_path):
    entry = Path(__file__).resolve().parents[2] / "__spark_entry__.py"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    command = [sys.executable, "-c", CODE, str(entry), TESTDATA, str(tmp_path / "shared")]
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) == 8
