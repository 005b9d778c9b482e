"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stintwise")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder the cluster shares (``spark.checkpoint.dir``).

    A machine-local folder serves only a local master, whose one process runs all tasks.
    """
    base = _scratch.get() or spark.conf.get("spark.checkpoint.dir", None) or local_base(spark.sparkContext.master)
    return f"{base.rstrip('/')}/stintwise/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def writing_to(path: str) -> Iterator[None]:
    """Within the block, shared folders are made under ``path``."""
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Whatever is written to shared folders within the block is removed after it."""
    path = shared_dir(spark, name)
    try:
        with writing_to(path):
            yield
    finally:
        remove(spark, path)


def local_base(master: str) -> str:
    """A temporary folder of this process; an error unless all tasks run in it."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return _temporary()


@cache
def _temporary() -> str:
    path = tempfile.mkdtemp(prefix="stintwise-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: a short lineage that outlives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
