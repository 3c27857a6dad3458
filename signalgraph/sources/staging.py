"""Cutting lineage: a frame read by several later steps is written once."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: dict[str, str] = {}
_staged: list[str] = []
_scope = threading.local()


def staging_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Only a plain local session
    without that setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _local_folder.get("path")
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder.setdefault("path", tempfile.mkdtemp(prefix="signalgraph-stage-"))


def staged_at(spark: SparkSession, name: str) -> str:
    """A new path for a table that later steps read; ``clear`` deletes it."""
    held = getattr(_scope, "held", _staged)
    held.append(f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return held[-1]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as parquet to the staging folder and gives it back read from
    there: losing an executor never recomputes what came before."""
    spark = df.sparkSession
    path = staged_at(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what this thread has staged inside: for work that a stream
    repeats with every micro-batch."""
    _scope.held = []
    try:
        yield
    finally:
        held = _scope.held
        del _scope.held
        for path in held:
            delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has staged. Call it when no frame that was read
    from there is needed any more, at the end of a job."""
    while _staged:
        delete(spark, _staged.pop())
