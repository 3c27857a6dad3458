"""Per-service aggregates, one moment or every detector tick, and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalgraph.functions import scalars as S
from signalgraph.functions.ordered import number_rows
from signalgraph.functions.quantiles import window_rollup
from signalgraph.params import Params
from signalgraph.sources.logs import last_ts, since, until, within

LATENCY_PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
RATE_COLUMNS = ["service", "total", "errors", "warns", "mean_lat", "p50", "p95", "p99", "error_rate"]
FEATURES = ["total", "errors", "warns", "mean_lat", "p95", "error_rate"]


def _sums():
    return {"errors": S.flag(S.is_error()), "warns": S.flag(F.col("level") == "WARN")}


def _finish(rolled: DataFrame, lead: list[str], probs: dict[str, float]) -> DataFrame:
    return rolled.select(
        *lead,
        "service",
        "total",
        "errors",
        "warns",
        F.coalesce("mean", F.lit(0.0)).alias("mean_lat"),
        *[F.coalesce(p, F.lit(0.0)).alias(p) for p in probs],
        S.ratio("errors", "total").alias("error_rate"),
    )


def service_rates(logs: DataFrame, p: Params, as_of: float | None = None) -> DataFrame:
    """Counts, latency quantiles and error rate per service over the last window."""
    as_of = last_ts(logs) if as_of is None else as_of
    rows = within(logs, as_of, p.window_s).withColumn("pane", F.lit(0).cast("bigint"))
    rolled = window_rollup(rows, ["service"], "latency_ms", _sums(), LATENCY_PROBS)
    return _finish(rolled, [], LATENCY_PROBS)


def last_tick_no(newest_ts: float, p: Params) -> int:
    """The first tick whose window ends after ``newest_ts``; no later one is looked at."""
    return int(newest_ts // p.tick_s) + 1


def service_ticks(
    logs: DataFrame, p: Params, probs: tuple[str, ...] = ("p50", "p95", "p99"), last: int | None = None
) -> DataFrame:
    """The same for every tick: windows ``[tick - window, tick)`` that hold rows.

    ``tick_no`` is the tick's end in units of the tick length.
    """
    chosen = {name: LATENCY_PROBS[name] for name in probs}
    rows = logs.withColumn("pane", S.bucket_index("ts", p.tick_s))
    last = last_tick_no(last_ts(logs), p) if last is None else last
    rolled = window_rollup(
        rows.select("service", "level", "latency_ms", "pane"),
        ["service"],
        "latency_ms",
        _sums(),
        chosen,
        span=p.ticks_per_window,
        last=last,
    )
    return finish_ticks(rolled, p, chosen)


def finish_ticks(rolled: DataFrame, p: Params, probs: dict[str, float]) -> DataFrame:
    rolled = rolled.withColumnRenamed("tick", "tick_no")
    return _finish(rolled.withColumn("tick", F.col("tick_no") * F.lit(p.tick_s)), ["tick_no", "tick"], probs)


def number_ticks(ticks: DataFrame, p: Params) -> DataFrame:
    """Distinct ticks of a frame with their running number ``seq``."""
    distinct = ticks.select("tick_no").distinct()
    return number_rows(distinct.withColumn("tick", F.col("tick_no") * F.lit(p.tick_s)), "tick_no", [], "seq", 4096)


def tick_numbers(logs: DataFrame, p: Params, last: int | None = None) -> DataFrame:
    """The ticks whose window holds any row, with their running number ``seq``."""
    last = last_tick_no(last_ts(logs), p) if last is None else last
    panes = logs.select(S.bucket_index("ts", p.tick_s).alias("pane")).distinct()
    ends = F.sequence(F.col("pane") + 1, F.least(F.col("pane") + p.ticks_per_window, F.lit(last).cast("bigint")))
    return number_ticks(panes.select(F.explode(ends).alias("tick_no")), p)


def feature_matrix(rates: DataFrame) -> DataFrame:
    """The six detector features per service (and tick, if present)."""
    lead = [c for c in ("tick_no", "tick") if c in rates.columns]
    return rates.select(*lead, "service", *[F.col(c).cast("double").alias(c) for c in FEATURES])


def bucket_bounds(as_of: float, p: Params) -> tuple[int, int]:
    """First bucket and the one after the last, in units of the bucket width."""
    end = int(as_of // p.bucket_s) + 1
    return end - p.buckets, end


def _spine(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.withColumn("bucket", F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(end - 1).cast("bigint"))))


def _bucket_rows(logs: DataFrame, p: Params, start: int, end: int) -> DataFrame:
    """Rows of the spine's buckets. Rows newer than its end are cut as well."""
    return (
        until(since(logs, start * p.bucket_s), end * p.bucket_s)
        .withColumn("bucket", S.bucket_index("ts", p.bucket_s))
        .filter(F.col("bucket") < end)
    )


def timeline(logs: DataFrame, p: Params, as_of: float | None = None) -> DataFrame:
    """Totals, errors and warnings per bucket; empty buckets count 0."""
    as_of = last_ts(logs) if as_of is None else as_of
    start, end = bucket_bounds(as_of, p)
    counts = (
        _bucket_rows(logs, p, start, end)
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum(S.flag(S.is_error())).alias("errors"),
            F.sum(S.flag(F.col("level") == "WARN")).alias("warns"),
        )
    )
    spine = logs.sparkSession.range(start, end).withColumnRenamed("id", "bucket")
    return spine.join(counts, "bucket", "left").select(
        (F.col("bucket") * F.lit(p.bucket_s)).alias("ts"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "errors", "warns")],
    )


def latency_series(
    logs: DataFrame, p: Params, as_of: float | None = None, service: str | None = None
) -> DataFrame:
    """Latency quantiles and mean per service and bucket; empty buckets are 0.

    All services seen in the range, or the one named.
    """
    as_of = last_ts(logs) if as_of is None else as_of
    start, end = bucket_bounds(as_of, p)
    rows = _bucket_rows(logs, p, start, end)
    if service is not None:
        rows = rows.filter(F.col("service") == service)
        axis = logs.sparkSession.range(1).select(F.lit(service).alias("service"))
    else:
        axis = rows.select("service").distinct()
    rolled = window_rollup(rows.withColumnRenamed("bucket", "pane"), ["service"], "latency_ms", {}, LATENCY_PROBS)
    rolled = rolled.withColumn("bucket", F.col("tick") - 1)
    return (
        _spine(axis, start, end)
        .join(rolled, ["service", "bucket"], "left")
        .select(
            "service",
            (F.col("bucket") * F.lit(p.bucket_s)).alias("ts"),
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50", "p95", "p99", "mean")],
        )
    )


def problem_rates(logs: DataFrame, p: Params, as_of: float | None = None) -> DataFrame:
    """Share of problem rows (WARN included) per service and bucket that has rows."""
    as_of = last_ts(logs) if as_of is None else as_of
    start, end = bucket_bounds(as_of, p)
    return (
        _bucket_rows(logs, p, start, end)
        .groupBy("service", "bucket")
        .agg(F.count(F.lit(1)).alias("total"), F.sum(S.flag(S.is_problem())).alias("problems"))
        .select("service", "bucket", S.ratio("problems", "total").alias("rate"))
    )


def error_rate_series(logs: DataFrame, p: Params, as_of: float | None = None) -> DataFrame:
    """``problem_rates`` with every bucket of every service; empty ones are 0."""
    as_of = last_ts(logs) if as_of is None else as_of
    start, end = bucket_bounds(as_of, p)
    rates = problem_rates(logs, p, as_of)
    return (
        _spine(rates.select("service").distinct(), start, end)
        .join(rates, ["service", "bucket"], "left")
        .select(
            "service",
            (F.col("bucket") * F.lit(p.bucket_s)).alias("ts"),
            F.coalesce("rate", F.lit(0.0)).alias("rate"),
        )
    )


SAMPLE_SLICE = 4096  # samples of a service per window


def zscores(ticks: DataFrame, p: Params, columns: tuple[str, ...] = ("total", "errors", "p95")) -> DataFrame:
    """Rolling z of each column over the service's last samples, itself included.

    Reads per-tick aggregates: a service has one row per tick however many logs
    it wrote, so a busy service is no bigger than a quiet one here. A service's
    samples are numbered and cut into slices that each begin with the samples its
    first rows look back on, so a long history is many windows.
    """
    numbered = number_rows(ticks, "tick_no", [], "_nth", SAMPLE_SLICE, ["service"])
    own = F.floor(F.col("_nth") / SAMPLE_SLICE)
    late = F.pmod("_nth", F.lit(SAMPLE_SLICE)) > SAMPLE_SLICE - p.z_samples
    sliced = numbered.withColumn("_own", own).withColumn(
        "_slice", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    recent = Window.partitionBy("service", "_slice").orderBy("_nth").rowsBetween(1 - p.z_samples, 0)
    out = sliced.withColumn("samples", F.count(F.lit(1)).over(recent))
    for c in columns:
        sd = F.stddev_pop(F.col(c).cast("double")).over(recent)
        mean = F.avg(F.col(c).cast("double")).over(recent)
        out = out.withColumn(
            f"z_{c}",
            F.when((F.col("samples") < p.z_min_samples) | (sd < 1e-6), F.lit(0.0)).otherwise(
                (F.col(c) - mean) / F.when(sd < 1e-6, F.lit(1.0)).otherwise(sd)
            ),
        )
    return out.filter("_slice = _own").drop("_nth", "_own", "_slice")
