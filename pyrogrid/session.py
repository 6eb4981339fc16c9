"""Session defaults and the shared folder for materialised intermediates."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot leaves methods above 8000 bytecodes uncompiled; very wide panel aggregations exceed
    # that, and then run faster without whole-stage code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app_name: str = "pyrogrid", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators assume (UTC dates, adaptive execution)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session that names none gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder to materialise tables")
    folder = tempfile.mkdtemp(prefix="pyrogrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# Blocks that hold a setting at the moment, and its value before the first of them.
_held: dict[tuple[int, str], list] = {}
_changing = threading.Lock()


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Holds a setting; blocks of several threads may overlap, the last to end restores it."""
    at = (id(spark), key)
    with _changing:
        _held.setdefault(at, [0, spark.conf.get(key, None)])[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _changing:
            _held[at][0] -= 1
            if not _held[at][0]:
                before = _held.pop(at)[1]
                if before is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """Writes in this block remove their shuffle files when they end.

    Otherwise the files stay until the driver collects the frames, so a job of many rounds needs
    the disk of all of them.  The frame that was written can still be run again: each run plans
    shuffles of its own.
    """
    return _set(spark, SHUFFLE_CLEANUP, "true")


def joined_where_they_are(spark: SparkSession):
    """Writes in this block join frames partitioned alike by some of the join keys without a shuffle."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def large_batches(spark: SparkSession):
    """Python tasks of writes in this block get few numbers a row, many rows at a time."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "100000")


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def wide_rows(spark: SparkSession):
    """Jobs in this block run plans whose generated methods are too long to be compiled without them.

    ``build_session`` sets this for good, but a session may come from elsewhere.
    """
    return _set(spark, HUGE_METHOD, SESSION_CONF[HUGE_METHOD])


def wide_rows_kept(spark: SparkSession) -> None:
    """``wide_rows`` from now on, for frames that the caller runs after this returned."""
    spark.conf.set(HUGE_METHOD, SESSION_CONF[HUGE_METHOD])


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write once to the shared folder and read back.

    Several jobs (folds, metrics, rank passes) then read the rows instead of recomputing their
    lineage, and a lost executor costs a re-read, not a refit.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark), wide_rows(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that ``materialise`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_parallel(spark: SparkSession, jobs: Sequence[Callable[[], object]], width: int = 4) -> list:
    """Run independent Spark jobs from driver threads; results keep the order of the jobs."""
    wrap = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=width) as pool:
        return [f.result() for f in [pool.submit(wrap(job)) for job in jobs]]
