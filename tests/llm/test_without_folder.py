"""Operators in a session that names no checkpoint folder, in a process of its own (tests/conftest.py always names one)."""

import os
import subprocess
import sys

from tests.conftest import ROOT

CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from fabula.llm import toolcalls
from fabula.llm.common import connected_components
pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
assert {tuple(r) for r in connected_components(pairs).collect()} == {(1, 1), (2, 1), (3, 1)}
calls = spark.createDataFrame([(1, "a", None), (1, "b", "a")], "conv_id long, call_id string, parent_id string")
assert {(r.call_id, r.level) for r in toolcalls.levels(calls).collect()} == {("a", 0), ("b", 1)}
"""


def test_components_and_levels_find_a_folder():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
