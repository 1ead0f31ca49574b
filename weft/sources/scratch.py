"""Paths that driver and executors share, and file systems by path."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system's scheme: one without a scheme belongs to the session's default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of spark.checkpoint.dir; a temporary folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{qualified(spark, base).rstrip('/')}/weft/{name}-{uuid.uuid4().hex}"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it, for Python tasks."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
