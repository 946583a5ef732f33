"""Session construction and the shared-storage helpers every operator uses."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "lodestore", cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """Local session for tests and bench; on a cluster the launcher's own settings stay in force."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: bytes of an Arrow batch between Spark and a Python worker, so that long texts don't fill a worker by their number
BATCH_BYTES = 8 << 20


def python_path(spark: SparkSession) -> None:
    """Let Python workers import this package although the driver was started in another folder, and bound their batches by size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


#: tables up to this size may be shuffled to spread them
SMALL_BYTES = 256 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table for work that is heavy per row.

    A table of ``SMALL_BYTES`` at most may lie in one row group and would keep one core busy; it is
    dealt to all of them. A larger one is read as it is. Projections and filters still reach the scan.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    In local mode one of our own is made where it is unset, and removed at exit; a cluster must name one.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"/tmp/lodestore-shared-{sc.applicationId}"
        atexit.register(shutil.rmtree, folder, True)
        found = f"file://{folder}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one. It goes when the driver's Python exits, or with ``clean``."""
    path = f"{shared_dir(spark)}/lodestore-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_remove, spark, path)
    return path


_OWN: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    local = path.removeprefix("file://")
    if local.startswith("/"):
        shutil.rmtree(local, ignore_errors=True)
    elif spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has materialized; frames that still read it can't be used afterwards."""
    _remove(spark, own_dir(spark))


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and return a reader of it.

    This cuts the lineage: a lost executor costs a reread, never a recomputation of the steps before.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestore_path = path
    made = _SCOPE.get()
    if made is not None:
        made.append(out)
    return out


#: tables that ``materialize`` wrote in this context's innermost ``scratch``; threads don't share it
_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(*keep: str) -> Iterator[None]:
    """On leaving, delete the tables that ``materialize`` wrote within, but those of the given names, which what goes on still reads; they belong to the scope around it, if any."""
    made: list[DataFrame] = []
    outer = _SCOPE.get()
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for df in made:
            if df._lodestore_path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep:
                discard(df)
            elif outer is not None:
                outer.append(df)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for a frame that nothing will read again."""
    path = getattr(df, "_lodestore_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
