import os
import subprocess
import sys

from loamdex.session import fresh_dir, materialise, shared_dir


def test_the_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    a, b = fresh_dir(spark, "x"), fresh_dir(spark, "x")
    assert a != b and a.startswith(shared_dir(spark))
    df = materialise(spark.range(5), "numbers")
    assert df.count() == 5 and df.dtypes == spark.range(1).dtypes


def test_what_a_process_wrote_goes_with_it(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from loamdex.session import materialise
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
materialise(spark.range(3), "t")
import os
print("FOLDERS", len([n for n in os.listdir({str(tmp_path)!r}) if n.startswith("loamdex-")]))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=200)
    assert "FOLDERS 1" in done.stdout and not [n for n in os.listdir(tmp_path) if n.startswith("loamdex-")]
