"""Trace reconstruction: spans, call depth, summaries and waterfall layout.

A trace may hold a large share of all rows, so no step gathers a trace's rows.
Per trace only its services are gathered, one entry each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgraph.functions import scalars as S
from signalgraph.functions.ordered import lookup

SPAN_COLUMNS = [
    "trace_id", "ts", "span_id", "service", "parent_service", "level", "latency_ms", "status_code", "message",
]


def trace_spans(logs: DataFrame, trace_id: str) -> DataFrame:
    """Rows of one trace in time order, with their depth. Not bound to a window."""
    spans = logs.filter(F.col("trace_id") == trace_id)
    return trace_depth(spans).orderBy("ts", "span_id")


def trace_summary(logs: DataFrame) -> DataFrame:
    """Start, duration, services and error flag per trace."""
    end = F.col("ts") + F.col("latency_ms") / 1000.0
    return logs.groupBy("trace_id").agg(
        F.min("ts").alias("started"),
        ((F.max(end) - F.min("ts")) * 1000.0).alias("duration_ms"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.max(S.is_error()).alias("has_errors"),
        F.count(F.lit(1)).alias("spans"),
    )


def _first_sights(logs: DataFrame) -> DataFrame:
    """Per trace, what a row learns from its parent service: when that service
    was first seen in the trace, and the depth of its children from then on."""
    place = F.struct("ts", "span_id")
    firsts = (
        logs.groupBy("trace_id", "service")
        .agg(F.min(F.struct(place.alias("place"), "parent_service")).alias("first"))
        .select("trace_id", F.struct("first.place", "service", "first.parent_service").alias("first"))
    )
    # A service's level is one more than the depth of its first row, which looks
    # up the services first seen before it.
    seen = F.aggregate(
        F.array_sort(F.collect_list("first")),
        F.expr("CAST(map() AS MAP<STRING, INT>)"),
        lambda acc, x: F.map_concat(
            acc,
            F.create_map(x["service"], F.coalesce(F.try_element_at(acc, x["parent_service"]), F.lit(0)) + 1),
        ),
    )
    return firsts.groupBy("trace_id").agg(seen.alias("levels"), F.collect_list("first").alias("firsts"))


def trace_depth(logs: DataFrame) -> DataFrame:
    """Depth of every row: in (ts, span_id) order, one more than the depth at
    which its parent service was first seen before it, else 0."""
    sights = _first_sights(logs).select(
        "trace_id",
        "levels",
        F.map_from_entries(F.transform("firsts", lambda x: F.struct(x["service"], x["place"]))).alias("places"),
    )
    spans = logs.select(*SPAN_COLUMNS)
    known = lookup(spans, sights, "trace_id", ["levels", "places"])
    parent_first = F.try_element_at(F.col("places"), F.col("parent_service"))
    depth = F.when(
        parent_first < F.struct("ts", "span_id"), F.try_element_at(F.col("levels"), F.col("parent_service"))
    )
    return known.select(*SPAN_COLUMNS, F.coalesce(depth, F.lit(0)).cast("int").alias("depth"))


def trace_waterfall(logs: DataFrame) -> DataFrame:
    """Bar offset and width of every row, in percent of its trace."""
    summary = trace_summary(logs).select(
        "trace_id",
        "started",
        F.when(F.bround("duration_ms", 2) == 0, 1.0).otherwise(F.bround("duration_ms", 2)).alias("total_ms"),
    )
    rows = lookup(
        logs.select("trace_id", "span_id", "service", "ts", "latency_ms"), summary, "trace_id", ["started", "total_ms"]
    )
    offset = (F.col("ts") - F.col("started")) * 1000.0
    left = S.clip(offset / F.col("total_ms") * 100.0, 0.0, 100.0)
    return rows.withColumn("offset_ms", offset).withColumn("left_pct", left).select(
        "trace_id",
        "span_id",
        "service",
        "offset_ms",
        "left_pct",
        F.greatest(
            F.lit(1.2), F.least(100.0 - F.col("left_pct"), F.col("latency_ms") / F.col("total_ms") * 100.0)
        ).alias("width_pct"),
    )
