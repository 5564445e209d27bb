"""The library stands without the training-data subpackage and its pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import __spark_entry__ as driver
queries, sql = driver.queries(), driver.oracle_sql()
assert len(queries) > 100 and set(sql) <= set(queries)
assert not [name for name in queries if name.startswith("op") or name == "pipeline"]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert queries["term_df"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_the_rest_stands_alone(tmp_path):
    root = Path(__file__).parents[1]
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
