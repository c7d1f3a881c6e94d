"""Python stages work from any working directory with a plain session:
the package reaches the executors through addPyFile."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
     .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
n = E.queries()["source_functions"](s, "/root/testdata/sf0.001").count()
print("ROWS", n)
"""


def test_python_stage_from_foreign_cwd(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "ROWS " in out.stdout and int(out.stdout.split("ROWS ")[1].split()[0]) > 0
