"""Functions travel with the job: executors need no copy of this repository."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from logtable.operators.rows import with_row_id
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([("a", 1), ("b", 2)], "v string, line_no long")
seen = spark.range(1).mapInPandas(lambda parts: (p.assign(id=[any({REPO!r} in x for x in __import__("sys").path)]) for p in parts), "id boolean")
print("FOUND", with_row_id(rows).select("row_id").distinct().count(), seen.first()[0])
"""


def test_row_id_without_the_repository_on_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "job.py"
    script.write_text(JOB)
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 2 False" in done.stdout, done.stderr[-2000:]
