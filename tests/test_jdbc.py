"""The database queries where the driver and the executors are processes of their own."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
from tideframe import plans
print(*(plans.QUERIES[q](spark, "/root/testdata/sf0.001").count() for q in ("scan_jdbc", "scan_jdbc_skewed")))
spark.stop()
"""


def test_executors_read_the_database(tmp_path):
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path / "shared")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.stdout.split()[-2:] == ["145", "1500"], done.stderr[-2000:]
