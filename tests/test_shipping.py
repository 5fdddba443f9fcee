"""Queries with Python workers run where only the driver can import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as driver
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for name in ("multiple_regression", "factorial_regression", "predicted_vs_actual", "posterior_map", "smooth_curve"):
    assert driver.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("all ran"), done.stderr[-2000:]
