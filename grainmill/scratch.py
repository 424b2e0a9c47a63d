"""Tables written for the length of a job, in the folder that all executors share.

spark.checkpoint.dir names the folder. Where it is unset, a local session gets one of its own, and a
cluster is refused: a machine's own folder would lose rows. What is written inside temporary() is deleted at its
end; what a result still reads stays until the program ends.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .errors import ArgumentValueError

_open: ContextVar[list[str] | None] = ContextVar("grainmill_scratch", default=None)
_left: list[tuple[SparkSession, str]] = []


@functools.cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="grainmill-")


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ArgumentValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own()
    return f"{base.rstrip('/')}/grainmill"


def path(spark: SparkSession, what: str, keep: bool = False) -> str:
    """A new path in the shared folder; keep: it outlives the temporary() around it."""
    out = f"{folder(spark)}/{what}-{uuid.uuid4().hex}"
    held = _open.get()
    if held is None or keep:
        _left.append((spark, out))
    else:
        held.append(out)
    return out


def written(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage, and survives lost executors."""
    to = path(df.sparkSession, what, keep)
    df.write.mode("overwrite").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end, but for those that are kept; nothing returned may read the others."""
    token = _open.set([])
    try:
        yield
    finally:
        held = _open.get()
        _open.reset(token)
        delete(spark, held)


@atexit.register
def _clear() -> None:
    for spark, p in _left:
        if spark.sparkContext._jsc is not None:  # a session that was stopped has no file system to ask
            with contextlib.suppress(Exception):
                delete(spark, [p])
