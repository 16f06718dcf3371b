"""Results that are read several times: written once to the folder that driver and executors share, or held by the driver while a batch is small."""

from __future__ import annotations

import atexit
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_small: contextvars.ContextVar[bool] = contextvars.ContextVar("small", default=False)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on one machine, as in tests, a folder that goes with this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="srcgraph-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def in_memory() -> bool:
    return _small.get()


@contextmanager
def small():
    """Inside, staged results are collected: only for batches whose size was checked."""
    token = _small.set(True)
    try:
        yield
    finally:
        _small.reset(token)


@contextmanager
def scratch(spark: SparkSession):
    """Inside, staged tables go to one folder, which is removed at the end."""
    at = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}"
    token = _folder.set(at)
    try:
        yield
    finally:
        _folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_folder: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


def local(df: DataFrame) -> DataFrame:
    """df collected, as one partition: plans over such alone need no shuffle."""
    held = df.toArrow()
    out = df.sparkSession.createDataFrame(held, df.schema).coalesce(1)
    out.held = held
    return out


def values(df: DataFrame) -> list:
    """Distinct values of the only column of a small table, nulls left out."""
    held = getattr(df, "held", None)
    found = held.column(0).to_pylist() if held is not None else [r[0] for r in df.collect()]
    return sorted({x for x in found if x is not None})


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts lineage, and what is read again is not computed again."""
    if _small.get():
        return local(df)
    at = f"{_folder.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def together(tasks: list[Callable]) -> list:
    """Run small jobs side by side: each is mostly waiting for the scheduler. Tasks of tasks run one after the other."""
    if len(tasks) < 2 or _inside.get():
        return [t() for t in tasks]

    def run(task):
        _inside.set(True)
        return task()

    return [f.result() for f in [_pool().submit(contextvars.copy_context().run, run, t) for t in tasks]]


_inside: contextvars.ContextVar[bool] = contextvars.ContextVar("inside", default=False)


@cache
def _pool() -> ThreadPoolExecutor:
    """Kept, since each thread has its own connection to the JVM."""
    return ThreadPoolExecutor(16, thread_name_prefix="srcgraph")


def all_staged(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    done = together([lambda k=k, t=t: staged(t, f"{name}-{k}") for k, t in tables.items()])
    return dict(zip(tables, done))
