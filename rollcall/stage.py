"""Stage tables: results written once to storage that every executor can read.

Iterative operators cut their lineage here.  A stage table survives the loss of
an executor, unlike cached blocks, and later reads prune its columns.
"""

from __future__ import annotations

import contextlib
import math
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: dict[str, str] = {}
#: Bytes of input for a task where an operator sets the number of tasks itself.
TASK_BYTES = 64 << 20
MOST_TASKS = 100_000


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: ``spark.checkpoint.dir``.  Where that is unset, local mode gets a temporary one and a cluster an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="rollcall-")
    return _local_dirs[app]


_lock = threading.Lock()
_writers: dict[str, tuple[int, str | None]] = {}


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within go at its end.  The first of several writers at once sets this, the last one restores it."""
    app = spark.sparkContext.applicationId
    with _lock:
        n, before = _writers.get(app, (0, None))
        if not n:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writers[app] = (n + 1, before)
    try:
        yield
    finally:
        with _lock:
            n, before = _writers.pop(app)
            if n > 1:
                _writers[app] = (n - 1, before)
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


#: Stage tables that are written while a ``released`` block runs.
_open: list[list[DataFrame]] = []


def _path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/rollcall-{name}-{uuid.uuid4().hex}"


def _known(table: DataFrame, path: str, name: str | None = None) -> DataFrame:
    table._stage_path, table._stage_table = path, name
    for scope in _open:
        scope.append(table)
    return table


def write_stage(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet under the stage root and return the path.

    The write's shuffle files are of no use afterwards, so Spark removes them at its end.
    """
    path = _path(df.sparkSession, name)
    with _cleaning(df.sparkSession):
        df.write.parquet(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a stage table and read back."""
    schema = df.schema
    path = write_stage(df, name)
    return _known(df.sparkSession.read.schema(schema).parquet(path), path)


def drop_stage(*tables: DataFrame | None) -> None:
    """Delete stage tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_stage_path", None)
        if path:
            spark = table.sparkSession
            if table._stage_table:
                spark.sql(f"DROP TABLE IF EXISTS {table._stage_table}")
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
            table._stage_path = None


@contextlib.contextmanager
def released() -> Iterator[list[DataFrame]]:
    """Stage tables written within go at the end, but for those put into the list that is given."""
    keep: list[DataFrame] = []
    scope: list[DataFrame] = []
    _open.append(scope)
    try:
        yield keep
    finally:
        _open.remove(scope)
        drop_stage(*(t for t in scope if not any(t is k for k in keep)))


def drop_session_stages(spark: SparkSession) -> int:
    """Delete all stage tables under the stage root; for the end of a session that has written its results.  Returns their number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in (fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "rollcall-*")) or [])]
    for path in found:
        fs.delete(path, True)
    return len(found)


#: Rows in memory take at most some so many times the bytes of the files they come from.
UNPACKED = 8


def input_bytes(df: DataFrame) -> int:
    """Size of ``df`` by the optimizer's estimate; 0 where it has none.

    The optimizer multiplies the sizes of joined tables, so what the read tables hold bounds its estimate.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    known = lambda p: n if (n := int(str(p.stats().sizeInBytes()))) < 1 << 60 else 0
    read = [known(leaves.apply(i)) for i in range(leaves.length())]
    if all(read):
        return min(int(str(plan.stats().sizeInBytes())), UNPACKED * sum(read))
    return known(plan)


def task_count(df: DataFrame) -> int:
    """Tasks for a shuffle of the whole of ``df``: the session's number, more if the input asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, math.ceil(input_bytes(df) / TASK_BYTES)), max(least, MOST_TASKS))


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a stage table bucketed by ``key``, so that several joins on the key shuffle its rows just once."""
    spark = df.sparkSession
    n, name, path = task_count(df), f"rollcall_{uuid.uuid4().hex}", _path(spark, "buckets")
    with _cleaning(spark):
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    return _known(spark.table(name), path, name)
