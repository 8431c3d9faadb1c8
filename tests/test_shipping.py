"""A session that was started elsewhere gets the package."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = f"""
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {ROOT!r})  # the driver only
from busvitals.sources.shipping import ship
ship(spark)
ship(spark)

@F.pandas_udf("string")
def where(x):
    import busvitals.operators.forest as f
    return x.map(lambda _: f.__file__)

print("found", spark.range(1).select(where(F.col("id").cast("string"))).first()[0])
spark.stop()
"""


def test_workers_import_the_shipped_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    found = [x for x in done.stdout.splitlines() if x.startswith("found ")]
    assert found and found[0].endswith(os.path.join("busvitals.zip", "busvitals", "operators", "forest.py")), done.stderr[-2000:]
