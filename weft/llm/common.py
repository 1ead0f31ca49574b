"""Shared plumbing of the training-data operators: scratch space, lineage cuts, Arrow batches.

Scratch space is always below ``spark.checkpoint.dir``, the one folder that driver and executors
share. Only where that setting is unset (tests, a single machine) a temporary folder is made.
"""

from __future__ import annotations

import ctypes
import gc
import resource
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Python workers take this many bytes of text at a time, whatever the size of Spark's batches.
SLICE_BYTES = 4 << 20

#: With this set, Spark removes a query's shuffle files when it ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A worker that holds no more than this between tasks has nothing to give back.
IDLE_BYTES = 150 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI or path without a final slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(base)
    # a path without a scheme is the default file system's, for Python tasks too
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, lost executors cost nothing, and what was shuffled for it goes."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with setting(spark, FREE_SHUFFLES, "true"):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within it, a setting of the session has this value."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what is run hands Python tasks at most so many rows at a time: both sides hold whole batches of texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write_file(path: str, chunks: Iterable[bytes]) -> int:
    """Write a file under a name of its own and move it into place, so that a repeated task leaves one whole file."""
    fs, at = open_fs(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part, n = f"{at}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part, compression=None) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    fs.move(part, at)
    return n


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def _resident() -> int:
    """Bytes of memory that this process holds."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * resource.getpagesize()
    except OSError:
        return 1 << 62


def give_back() -> None:
    """Return freed memory to the system if there is much of it: idle workers share the executor's."""
    if _resident() > IDLE_BYTES:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)


def tidy(task: Callable) -> Callable:
    """A task's function that gives its memory back when it ends, since Spark reuses its worker."""

    @wraps(task)
    def run(*args, **how) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(*args, **how)
        finally:
            give_back()

    return run


def pieces(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes in a text column (one row at least)."""
    if not batch.num_rows:
        return
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, x in enumerate(n.tolist()):
        if i > start and held + x > limit:
            yield batch.slice(start, i - start)
            pa.default_memory_pool().release_unused()
            start, held = i, 0
        held += x
    yield batch.slice(start)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that none of a table's columns has, or begins with, in any case."""
    mark = "_w"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [f"{mark}{n}" for n in names]
