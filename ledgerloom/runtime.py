"""Session helpers: where intermediate tables live, and how a plan is cut into stages that survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Path of each intermediate table that is still there -> (application id, Hadoop configuration it was written with).
_WRITTEN: dict[str, tuple[str, object]] = {}
#: Application id -> folder chosen for a session on one machine.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's ``spark.checkpoint.dir``. Where that is unset, a session on one machine
    (``local[...]``, as in tests) gets a temporary folder; on a cluster a machine's own folder would lose rows, so there
    a ValueError asks for the setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share, for intermediate tables")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = where = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        _WRITTEN[where] = (sc.applicationId, sc._jsc.hadoopConfiguration())
    return _LOCAL[sc.applicationId]


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, keeps statistics for the
    planner, and needs no executor to stay alive. The files go with ``discard``, ``release`` or ``intermediates``, at the
    latest when the driver process ends, whether or not the session was stopped before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{re.sub(r'[^a-z0-9_]', '_', label.lower())}-{uuid.uuid4().hex}"
    _WRITTEN[path] = (spark.sparkContext.applicationId, spark.sparkContext._jsc.hadoopConfiguration())
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder beside the intermediate tables, removed with them."""
    path = f"{shared_dir(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = (spark.sparkContext.applicationId, spark.sparkContext._jsc.hadoopConfiguration())
    return path


def discard(df: DataFrame | None) -> None:
    """Remove a table of ``materialize`` that no plan reads any more, such as the last round of an iteration."""
    if (path := getattr(df, "_written_at", None)) is not None:
        _remove(path)


def release(spark: SparkSession) -> None:
    """Remove every intermediate table of this session; results that still read them must be written before."""
    app = spark.sparkContext.applicationId
    for path in [p for p, (owner, _) in _WRITTEN.items() if owner == app]:
        _remove(path)
    _LOCAL.pop(app, None)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """``with intermediates(spark): ...write results...`` leaves none of the tables written inside it."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [p for p in _WRITTEN if p not in before and p not in _LOCAL.values()]:
            _remove(path)


def _remove(path: str) -> None:
    if (held := _WRITTEN.pop(path, None)) is None:
        return
    from pyspark import SparkContext

    p = SparkContext._jvm.org.apache.hadoop.fs.Path(path)  # the JVM outlives a stopped session
    p.getFileSystem(held[1]).delete(p, True)


@atexit.register
def _clean() -> None:
    for path in list(_WRITTEN):
        try:
            _remove(path)
        except Exception as e:  # say so: a file left behind must not pass unseen
            print(f"ledgerloom: {path} was not removed: {type(e).__name__}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables below this size may lie in one file, which one task would read and compute alone.
SPREAD_BELOW = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt out to all cores before work that is heavy per row; larger tables are many tasks anyway
    and stay where they are read (no shuffle)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BELOW else df
