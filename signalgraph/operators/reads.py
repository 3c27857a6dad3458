"""Ad-hoc reads over the log table: feed, search, recent traces and problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalgraph.functions import scalars as S
from signalgraph.params import Params
from signalgraph.schema import LOG_COLUMNS
from signalgraph.sources.logs import last_ts, within

HIT_COLUMNS = ["ts", "service", "level", "message", "trace_id", "span_id", "latency_ms"]


def _newest():
    return [F.col("ts").desc(), F.col("span_id").asc()]


def _matches(logs: DataFrame, service: str | None, level: str | None) -> DataFrame:
    """Equality filters; none or ``*`` means any."""
    if service and service != "*":
        logs = logs.filter(F.col("service") == service)
    if level and level != "*":
        logs = logs.filter(F.col("level") == level)
    return logs


def recent_logs(logs: DataFrame, limit: int = 60) -> DataFrame:
    """The last ``limit`` records, newest first."""
    return logs.select(*LOG_COLUMNS).orderBy(*_newest()).limit(limit)


def matching_logs(
    logs: DataFrame,
    p: Params,
    query: str = "",
    service: str | None = None,
    level: str | None = None,
    as_of: float | None = None,
) -> DataFrame:
    """Rows of the window whose message contains ``query`` in any letter case.
    ``%`` and ``_`` in the query stay wildcards."""
    as_of = last_ts(logs) if as_of is None else as_of
    rows = _matches(within(logs, as_of, p.window_s), service, level)
    return rows.filter(F.col("message").ilike(f"%{query}%")) if query else rows


def search_logs(logs: DataFrame, p: Params, query: str = "", limit: int = 50, **where) -> DataFrame:
    """The newest ``limit`` hits."""
    hits = matching_logs(logs, p, query, **where)
    return hits.select(*HIT_COLUMNS).orderBy(*_newest()).limit(limit)


def search_total(logs: DataFrame, p: Params, query: str = "", **where) -> DataFrame:
    """How many rows match, before the limit."""
    return matching_logs(logs, p, query, **where).agg(F.count(F.lit(1)).alias("total_matches"))


def recent_traces(
    logs: DataFrame, p: Params, limit: int = 30, errors_only: bool = False, as_of: float | None = None
) -> DataFrame:
    """Traces by their latest row in the window, newest first."""
    as_of = last_ts(logs) if as_of is None else as_of
    rows = within(logs, as_of, p.window_s)
    if errors_only:
        rows = rows.filter(S.is_error())
    return (
        rows.groupBy("trace_id")
        .agg(F.max("ts").alias("latest"))
        .orderBy(F.col("latest").desc(), F.col("trace_id").asc())
        .limit(limit)
    )


def recent_problems(
    logs: DataFrame, p: Params, service: str | None = None, limit: int = 10, as_of: float | None = None
) -> DataFrame:
    """The newest WARN and error rows: of one service, or of each service."""
    as_of = last_ts(logs) if as_of is None else as_of
    rows = within(logs, as_of, p.recent_problems_s).filter(S.is_problem()).select(*LOG_COLUMNS)
    if service is not None:
        return rows.filter(F.col("service") == service).orderBy(*_newest()).limit(limit)
    newest = Window.partitionBy("service").orderBy(*_newest())
    return rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)


def services(logs: DataFrame) -> DataFrame:
    return logs.select("service").distinct()


def inserted_total(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("total_inserted"))
