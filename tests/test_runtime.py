"""Intermediate tables: where they lie, and that none stays behind."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from ledgerloom import runtime

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from ledgerloom import runtime
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
assert runtime.materialize(spark.range(5), "five").count() == 5
spark.stop()
"""


def _files(folder):
    return [f for _, _, fs in os.walk(folder) for f in fs]


def test_a_stopped_session_leaves_nothing(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(runtime.__file__)))
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], check=True, timeout=120, env={**os.environ, "PYTHONPATH": root})
    assert not _files(tmp_path)


def test_tables_go_when_told(spark):
    known = set(runtime._WRITTEN)
    with runtime.intermediates(spark):
        old = runtime.materialize(spark.range(3), "a b")
        new = runtime.materialize(old.filter("id > 0"), "round")
        runtime.discard(old)
        runtime.discard(old)
        runtime.discard(spark.range(1))
        assert not os.path.exists(old._written_at.removeprefix("file:")) and new.count() == 2
    assert set(runtime._WRITTEN) == known
    kept = runtime.materialize(spark.range(2), "kept")
    runtime.release(spark)
    assert kept._written_at not in runtime._WRITTEN


def _session(master, where=None):
    conf = SimpleNamespace(hadoopConfiguration=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: where), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}", _jsc=conf))


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            runtime.shared_dir(_session(master))
        assert runtime.shared_dir(_session(master, "s3://b/c/")) == "s3://b/c"


def test_one_machine_chooses_a_folder_once():
    s = _session("local[4]")
    where = runtime.shared_dir(s)
    assert where.startswith("file:///") and runtime.shared_dir(s) == where
    runtime._WRITTEN.pop(where)
    runtime._LOCAL.pop("app-local[4]")
    os.rmdir(where.removeprefix("file://"))
