"""Session helpers: a local session for tests and benches, scratch space, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

# Below this estimated size an input is processed with single-buffer aggregates
# (exact `percentile`, unpartitioned windows); above it the bucketed forms are used.
SMALL_INPUT_BYTES = 64 * 1024 * 1024


def local_session(cpus: int | str = "*", app: str = "plumbline", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session it gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    It is read from the session.  Only a local master may fall back to a fresh
    temporary folder: on a cluster a machine-local path would be lost with its machine.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="plumbline-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def estimated_bytes(df: DataFrame) -> float:
    """Optimizer's size estimate of `df`; no job runs.  Unknown counts as infinite."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return float(str(stats.sizeInBytes()))
    except Exception:
        return float("inf")


def is_small(df: DataFrame, limit: int = SMALL_INPUT_BYTES) -> bool:
    return estimated_bytes(df) <= limit


def stage(df: DataFrame, name: str, small: bool | None = None) -> DataFrame:
    """Keep a frame that several passes read.

    Small frames are persisted.  Large ones are written as parquet to the shared
    checkpoint folder: that cuts the lineage, survives lost executors and lets each
    later pass read only the columns it needs.
    """
    if is_small(df) if small is None else small:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bounded_broadcast(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast `df` only once it is known to have at most `limit` rows.

    Meant for per-class and per-column tables.  A larger one is returned unchanged, and the
    optimizer then joins it by shuffle.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def reads_memory(df: DataFrame) -> bool:
    """Whether the plan starts from a persisted frame."""
    try:
        return "InMemoryRelation" in df._jdf.queryExecution().withCachedData().toString()
    except Exception:
        return False


@contextmanager
def several_passes(df: DataFrame) -> Iterator[DataFrame]:
    """A frame for a few eager passes.

    A small input often sits in one file split, which one core would read again and again:
    it is spread over the cores and kept in memory until the passes are done.  Larger inputs
    have splits enough and are scanned as they are.
    """
    spark = df.sparkSession
    if not is_small(df) or reads_memory(df):
        yield df
        return
    spread = df.repartition(spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield spread
    finally:
        spread.unpersist()


#: Fits, folds or trials that run at the same time.
PARALLEL = 4


def concurrently(spark: SparkSession, tasks: Sequence[Callable[[], object]], parallel: int = PARALLEL) -> list[object]:
    """The result of each task, in order; up to `parallel` run at a time, each in a scheduler pool of its own.

    A task's failure is raised once the tasks under way have ended; those not begun by then are not.
    For tasks of many short jobs, which leave most cores idle one after the other.  Under the FAIR scheduler the pools
    share the cores evenly; under FIFO jobs of several tasks still fill idle cores.
    """

    def run(number: int, task: Callable[[], object]) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"plumbline-{number % max(1, parallel)}")
        return task()

    if parallel <= 1 or len(tasks) <= 1:
        before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        try:
            return [run(0, task) for task in tasks]
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)
    with ThreadPoolExecutor(parallel) as pool:
        begun = [pool.submit(inheritable_thread_target(run), i, task) for i, task in enumerate(tasks)]
        try:
            return [f.result() for f in begun]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def settled(table: DataFrame) -> DataFrame:
    """A finished copy of a column-sized report table, so that showing it again scans nothing."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)
