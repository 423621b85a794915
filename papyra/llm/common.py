"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: What a Python worker keeps from task to task; settle() empties them.
caches: list[dict] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests, one machine)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not _one_machine(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="papyra-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: later stages survive lost executors without recomputing it."""
    path = f"{shared_root(df.sparkSession)}/papyra/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() whose every reader has been written itself; other DataFrames are left alone."""
    for one in tables:
        path = _paths.pop(one, None)
        if path:
            at = one.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(one.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files and broadcasts of what has been written, and the driver and the executors give freed memory back."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    trim(spark)
    if not _one_machine(spark):
        settle(spark)


def _one_machine(spark: SparkSession) -> bool:
    """Is the driver's JVM the only executor?"""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def settle(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage, after which their heaps shrink to what lives, and the Python workers forget their caches and tidy up.

    One task for each core: executors that are free get as many as they have cores, so each idle worker gets one. An executor
    or worker that gets none only keeps its memory."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("none")).mapInArrow(_forget, "none string").write.format("noop").mode("overwrite").save()


def _forget(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of this module, not of a closure, so that a worker empties its own caches and not a copy that came with the task."""
    for _ in batches:
        pass
    for cache in caches:
        cache.clear()
    tidy()
    time.sleep(0.1)  # else a quick worker may take another one's task
    yield from ()


def trim(spark: SparkSession) -> str | None:
    """Gives what the driver's JVM has freed outside its heap (compiled plans, network buffers) back to the system. HotSpot has the command from 17.0.9 on, with glibc; elsewhere nothing happens."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # the server's own class is closed to callers, its interface is not
        return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return None


def tidy() -> None:
    """Gives what a reused worker's earlier tasks have freed back to the system, and from now on large arrays at once (glibc)."""
    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()  # the modules stay; later collections need not visit them
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD: else it grows with what was freed
        libc.malloc_trim(0)


def blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut [0, len(sizes)) into runs of at most limit in total; an item above the limit stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + count)."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
