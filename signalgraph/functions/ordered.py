"""Helpers for work that depends on a global or per-key order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, lead: str, ties: list[str], out: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Adds ``out`` = 1, 2, 3 … in the order of numeric ``lead``, then ``ties``; for each
    value of ``by`` apart.

    Rows are ranked inside slices of ``lead`` of the given width; only one row
    per slice meets in a single window, to add up the sizes before it.
    """
    by = by or []
    sliced = df.withColumn("_slice", F.floor(F.col(lead) / F.lit(float(width))))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(lead, *ties)
    return (
        sliced.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*by, "_slice"])
        .withColumn(out, (F.col("_before") + F.col("_rank")).cast("bigint"))
        .drop("_slice", "_rank", "_before")
    )


def chain_by_gap(moments: DataFrame, ts: str, gap: float, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``, the first ``ts`` of the run each moment belongs to; a new run
    starts after a pause longer than ``gap``.

    Pauses inside slices of time are found per slice; one row per slice then
    carries the open run from slice to slice.
    """
    by = by or []
    slice_s = max(gap * 1000.0, 1.0)
    sliced = moments.withColumn("_slice", F.floor(F.col(ts) / F.lit(slice_s)))
    inside = Window.partitionBy(*by, "_slice").orderBy(ts)
    edges = sliced.groupBy(*by, "_slice").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    across = Window.partitionBy(*by).orderBy("_slice") if by else Window.orderBy("_slice")
    edges = edges.withColumn("_prev", F.lag("_last").over(across))
    flagged = (
        sliced.join(edges, [*by, "_slice"])
        .withColumn("_prev", F.coalesce(F.lag(ts).over(inside), F.col("_prev")))
        .withColumn("_start", F.when(F.col("_prev").isNull() | (F.col(ts) - F.col("_prev") > gap), F.col(ts)))
        .withColumn("_open", F.last("_start", ignorenulls=True).over(inside))
    )
    carried = (
        flagged.groupBy(*by, "_slice")
        .agg(F.max("_start").alias("_start"))
        .withColumn(
            "_carry",
            F.last("_start", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select(*by, "_slice", "_carry")
    )
    return (
        flagged.join(carried, [*by, "_slice"])
        .withColumn(out, F.coalesce("_open", "_carry"))
        .drop("_slice", "_first", "_last", "_prev", "_start", "_open", "_carry")
    )


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    start: Callable[[], Any],
    step: Callable[[Any, tuple], Iterable[tuple]],
    schema: str,
    finish: Callable[[Any, tuple], Iterable[tuple]] | None = None,
) -> DataFrame:
    """Feeds the rows of each key, in order, to ``step`` with a running state.

    Spark partitions by key and sorts; a task streams its sorted rows in Arrow
    batches and holds one key's state and one batch, never a whole group.
    ``step(state, row)`` and ``finish(state, key)`` yield output rows. The key
    columns must come first in ``df``.
    """
    width = len(keys)
    columns = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*[batch[c].tolist() for c in batch.columns]):
                if row[:width] != key:
                    if key is not None and finish:
                        out.extend(finish(state, key))
                    key, state = row[:width], start()
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=columns)
        if key is not None and finish:
            yield pd.DataFrame(list(finish(state, key)), columns=columns)

    return spread_by(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Partitions by key for work whose cost is Python time, not bytes: the
    session's shuffle width is kept, small inputs are not packed into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def lookup(rows: DataFrame, found: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``rows`` with the ``values`` that ``found`` has for their ``key`` (one row per key).

    A few keys may hold most rows: it is a plain left join, whose hot partitions
    adaptive execution splits by rows of the left side.
    """
    return rows.join(found.select(key, *values), key, "left")
