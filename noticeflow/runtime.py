"""Session helpers: shared checkpoint folder, staged tables, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is staged: shuffle files go when the write ends, and batches of rows for Python stay small, also where rows are long
#: (a batch stands in memory on both sides, twice while it grows, for each task of an executor).
STAGING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: what the cluster names in
    ``spark.checkpoint.dir``, or, only where that is unset (tests on one
    machine), a new temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="noticeflow-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Cuts lineage (lost executors read it again), fixes non-deterministic
    columns, gives the planner true sizes, and lets the shuffle files of the
    write go as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    with _conf(spark, STAGING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Gives a function ``keep``; tables that are staged within go when it ends, but for those that were kept."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _OPEN.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _OPEN.pop()
        paths = {df._staged_path for df in kept if hasattr(df, "_staged_path")}
        release(*(df for df in made if df._staged_path not in paths))


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no later read needs."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_enough(df: DataFrame, limit_bytes: int) -> bool:
    """Whether the planner's size of ``df`` (true for staged tables) is within the limit."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) <= limit_bytes


def maybe_broadcast(df: DataFrame, limit_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its size is within the limit, else as it is."""
    return F.broadcast(df) if small_enough(df, limit_bytes) else df


def ship(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package from where the driver has it.
    On a cluster without a shared file system, submit it with --py-files instead."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` on workers that can import this package. A worker serves many tasks: at the end of each
    the memory of its batches is given back."""
    ship(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


_HELD: dict = {}


def held(key, load):
    """What ``load()`` gives, made once for a key in this process; a Python worker serves many tasks, which share it."""
    if key not in _HELD:
        _HELD[key] = load()
    return _HELD[key]
