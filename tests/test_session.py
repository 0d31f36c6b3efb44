import os
import subprocess
import sys

import pytest

from quill import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class Cluster:
    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_unset_folder_is_an_error_on_a_cluster():
    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(Cluster)
    assert not session.is_local("local-cluster[3,2,1024]") and session.is_local("local[4]")


def test_runs_from_any_folder(tmp_path):
    """Python stages find the package although the session starts elsewhere."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for k in ("encode_sequences", "knn_within_class"):
    print(k, e.queries()[k](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "encode_sequences 200" in done.stdout


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time
    from quill.session import _CLEANED, materialize
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {str(f) for f in blocks.getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    before, setting = shuffled(), spark.conf.get(_CLEANED, None)
    df = spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").sum("id")
    assert materialize(df).count() == 7
    assert materialize(df).count() == 7  # the same rows again
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    left = {f for f in shuffled() - before}
    assert spark.conf.get(_CLEANED, None) == setting
    assert len(left) <= 2 * 4, left  # of the two counts only, which are not writes
