"""What several operators share: written tables, slices of a batch, global running totals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from signalgraph.sources.staging import delete, staged_at

#: Most ranges that document ids are divided into.
RANGES = 50_000
#: Text bytes that a task handles at a time.
SLICE_BYTES = 8_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, jobs hand their Python workers no more than ``SLICE_BYTES`` at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(SLICE_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a
    lost executor costs only the task that ran on it."""
    spark = df.sparkSession
    path = staged_at(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.settled_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes settled tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "settled_at", None)
        if path:
            delete(df.sparkSession, path)


def id_bounds(docs: DataFrame, size: int) -> list[int]:
    """Document ids that divide a table (doc_id, text) into ranges of about ``size`` bytes
    of text, ``RANGES`` at most: what the driver holds does not grow beyond that."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(1, math.ceil(total / size)), RANGES)
    if n == 1:
        return []
    shares = F.lit([k / n for k in range(1, n)])
    return sorted(set(docs.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 10 * n)))).first()[0] or []))


def without(docs: DataFrame, keys: dict[str, Column], bad: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``keys`` (null equals null) are a row of ``bad``,
    whatever columns ``docs`` has."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(c) for c, k in keys.items()])
    bad = bad.select(*[F.col(c).alias(f"bad_{c}") for c in keys]).distinct()
    same = [rows[c].eqNullSafe(bad[f"bad_{c}"]) for c in keys]
    return rows.join(bad, same, "left_anti").select("row.*")


def blobs(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``most`` bytes in each."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) // most) if len(size) else size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of columns."""
    kind = T.StructType.fromDDL(schema)
    names = kind.fieldNames()
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([_array(columns[n], arrow.field(n).type) for n in names], schema=arrow)
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    return df.mapInArrow(run, kind)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def with_offsets(parts: DataFrame, key: str, total: str, name: str) -> DataFrame:
    """``key`` and the sum of ``total`` over all smaller keys, as ``name``. ``parts``
    has a row for each partition or group of a job, never for each record."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(key, F.coalesce(F.sum(total).over(before), F.lit(0)).cast("long").alias(name))
