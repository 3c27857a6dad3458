"""Assembled results: KPI row, service detail, metrics text, live snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from signalgraph.functions import scalars as S
from signalgraph.operators import detect as D
from signalgraph.operators import graph as G
from signalgraph.operators import incidents as N
from signalgraph.operators import rates as R
from signalgraph.operators import reads
from signalgraph.operators import templates as T
from signalgraph.plans.replay import Replay
from signalgraph.schema import LOG_COLUMNS


def kpi(replay: Replay) -> DataFrame:
    """One row at the latest tick. Every part is one number, so the parts are
    stacked as rows and folded by one aggregate."""
    p = replay.p
    line = R.timeline(replay.raw_logs, p, replay.last_ts)
    rates = replay.ticks
    recent = replay.anomalies.filter((F.col("tick") <= replay.now) & (F.lit(replay.now) - F.col("tick") <= p.anomaly_recent_s))

    def one(name: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")

    parts = [
        one("logs_per_sec", line, F.bround(F.sum("total") / max(1.0, p.window_s), 2)),
        one("error_rate", line, F.bround(F.sum("errors") / F.greatest(F.sum("total"), F.lit(1)), 4)),
        one("active_services", rates.filter(F.col("tick_no") == replay.last_tick_no), F.count(F.lit(1))),
        one("anomalies_last_min", recent, F.count(F.lit(1))),
        one("templates_tracked", replay.templates, F.count(F.lit(1))),
        one("active_incidents", replay.board().filter("state <> 'resolved'"), F.count(F.lit(1))),
    ]
    stacked = reduce(DataFrame.unionByName, parts)

    def pick(name: str, kind: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("value"))).cast(kind).alias(name)

    row = stacked.agg(
        pick("logs_per_sec", "double"),
        pick("error_rate", "double"),
        pick("active_services", "bigint"),
        pick("anomalies_last_min", "bigint"),
        pick("templates_tracked", "bigint"),
        pick("active_incidents", "bigint"),
    )
    return row.select(
        "*",
        F.lit(p.window_s).alias("window_seconds"),
        F.bround(F.lit(replay.now - replay.started), 1).alias("uptime_seconds"),
        # fixed values: bounds of the bands
        S.tone("error_rate", 0.05, 0.02).alias("error_rate_tone"),
        S.tone("anomalies_last_min", 4, 0).alias("anomalies_tone"),
        S.tone("active_incidents", 0).alias("incidents_tone"),
    )


def graph_snapshot(replay: Replay) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph at the latest tick, rounded for display."""
    nodes = G.nodes_at(replay.node_metrics, replay.edge_calls, replay.last_tick_no).select(
        "service",
        "grp",
        F.bround("logs_per_min", 2).alias("logs_per_min"),
        F.bround("error_rate", 4).alias("error_rate"),
        F.bround("mean_latency_ms", 2).alias("mean_latency_ms"),
        F.bround("health", 3).alias("health"),
    )
    now = replay.edge_weights.filter(F.col("tick_no") == replay.last_tick_no)
    edges = G.graph_edges(now).select("source", "target", F.bround("weight", 3).alias("weight"))
    return nodes, edges


def service_detail(replay: Replay, service: str | None = None) -> DataFrame:
    """Everything known about a service (or each one) at the latest moment.

    All parts are keyed by service and bounded: one bucket series, at most 8
    templates and 10 problems, one edge per neighbour.
    """
    p, as_of = replay.p, replay.last_ts

    def only(df: DataFrame) -> DataFrame:
        return df if service is None else df.filter(F.col("service") == service)

    rates = only(R.service_rates(replay.raw_logs, p, as_of))
    edges = graph_snapshot(replay)[1]
    edge = F.struct("source", "target", "weight")
    up = edges.groupBy(F.col("target").alias("service")).agg(F.array_sort(F.collect_list(edge)).alias("upstream"))
    down = edges.groupBy(F.col("source").alias("service")).agg(F.array_sort(F.collect_list(edge)).alias("downstream"))
    series = (
        only(R.latency_series(replay.raw_logs, p, as_of))
        .groupBy("service")
        .agg(F.array_sort(F.collect_list(F.struct("ts", "p50", "p95", "p99", "mean"))).alias("latency_series"))
    )
    top = (
        only(T.top_templates_by_service(replay.logs, p, as_of=as_of))
        .groupBy("service")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("place", "template_id", "example", "level", "count", "first_seen", "last_seen")
                )
            ).alias("top_templates")
        )
    )
    problems = (
        only(reads.recent_problems(replay.logs, p, as_of=as_of))
        .groupBy("service")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", *[c for c in LOG_COLUMNS if c != "service"]))).alias(
                "recent_errors"
            )
        )
    )
    outlook = replay.forecast_now().select(
        "service",
        F.bround("forecast", 4).alias("forecast_error_rate"),
        F.bround("stddev", 4).alias("forecast_stddev"),
    )
    core = rates.select(
        "service",
        S.group_of().alias("grp"),
        F.bround(S.per_minute("total", p.window_s), 2).alias("logs_per_min"),
        F.bround("error_rate", 4).alias("error_rate"),
        F.bround("mean_lat", 2).alias("mean_latency_ms"),
        F.bround("p95", 2).alias("p95_latency_ms"),
        F.bround(S.health("error_rate", "p95"), 3).alias("health"),
    )
    whole = reduce(lambda a, b: a.join(b, "service", "left"), [up, down, series, top, problems, outlook], core)
    lists = [f for f in whole.schema.fields if isinstance(f.dataType, ArrayType)]
    return whole.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in lists})


# fixed values: family, type and help text of each exported metric
GLOBAL_METRICS = [
    ("logs_per_sec", "gauge", "Logs per second over the window."),
    ("error_rate", "gauge", "Share of error logs over the window."),
    ("active_incidents", "gauge", "Incidents not yet resolved."),
    ("templates_tracked", "gauge", "Log templates found so far."),
    ("total_inserted", "counter", "Logs stored so far."),
]
SERVICE_METRICS = [
    ("service_logs_total", "gauge", "Logs of a service in the window.", "total", "%.0f"),
    ("service_error_rate", "gauge", "Error rate of a service in the window.", "error_rate", "%.4f"),
    ("service_p95_latency_ms", "gauge", "95th percentile latency of a service (ms).", "p95", "%.2f"),
]


def metrics(kpi_row: DataFrame, inserted: DataFrame, rates: DataFrame) -> DataFrame:
    """Samples in long form: family order, name, type, help, labels, value."""

    def sample(df, order, name, kind, help_text, value, labels=None):
        return df.select(
            F.lit(order).alias("family"),
            F.lit(name).alias("name"),
            F.lit(kind).alias("type"),
            F.lit(help_text).alias("help"),
            labels if labels is not None else F.expr("CAST(map() AS MAP<STRING, STRING>)").alias("labels"),
            value.cast("string").alias("value"),
        )

    parts = []
    for i, (name, kind, text) in enumerate(GLOBAL_METRICS):
        source = inserted if name == "total_inserted" else kpi_row
        parts.append(sample(source, i, name, kind, text, F.col(name)))
    by_service = F.create_map(F.lit("service"), F.col("service")).alias("labels")
    for i, (name, kind, text, column, shown) in enumerate(SERVICE_METRICS, len(GLOBAL_METRICS)):
        value = F.format_string(shown, F.col(column).cast("double"))
        parts.append(sample(rates, i, name, kind, text, value, by_service))
    return reduce(DataFrame.unionByName, parts)


def metrics_text(samples: DataFrame, prefix: str = "signalgraph_") -> DataFrame:
    """The samples as exposition lines, in order: HELP, TYPE, then values."""
    name = F.concat(F.lit(prefix), F.col("name"))
    label = F.when(
        F.size("labels") > 0, F.concat(F.lit('{service="'), F.try_element_at("labels", F.lit("service")), F.lit('"}'))
    ).otherwise("")
    heads = samples.select("family", "name", "type", "help").distinct()
    lines = (
        heads.select("family", F.lit(0).alias("part"), F.lit("").alias("at"), F.concat(F.lit("# HELP "), name, F.lit(" "), "help").alias("line"))
        .unionByName(
            heads.select("family", F.lit(1).alias("part"), F.lit("").alias("at"), F.concat(F.lit("# TYPE "), name, F.lit(" "), "type").alias("line"))
        )
        .unionByName(
            samples.select("family", F.lit(2).alias("part"), label.alias("at"), F.concat(name, label, F.lit(" "), "value").alias("line"))
        )
    )
    return lines.orderBy("family", "part", "at").select("family", "part", "at", "line")


def write_metrics(lines: DataFrame, path: str) -> None:
    """The export is a page of text, one line per family and service."""
    lines.orderBy("family", "part", "at").select("line").coalesce(1).write.mode("overwrite").text(path)


def newest_logs(replay: Replay, limit: int) -> DataFrame:
    """The last records with their template ids: only these are masked to look them up."""
    return T.assign_templates(reads.recent_logs(replay.raw_logs, limit), replay.mined[1]).select(*LOG_COLUMNS)


def snapshot(replay: Replay, logs: int = 60, anomalies: int = 30, incidents: int = 15) -> DataFrame:
    """The live message as one row. Each list is a bounded top-k or has one entry
    per service, edge, bucket or rule; the parts meet on their common moment."""
    p, now = replay.p, replay.now

    def listed(df: DataFrame, name: str, *first: Column) -> DataFrame:
        """All rows as one sorted list; ``first`` leads the order."""
        lead = [c.alias(f"o{i}") for i, c in enumerate(first)]
        items = F.array_sort(F.collect_list(F.struct(*lead, F.struct(*df.columns).alias("item"))))
        return df.agg(items.alias("items")).select(F.lit(now).alias("moment"), F.col("items.item").alias(name))

    nodes, edges = graph_snapshot(replay)
    shown = D.recent_anomalies(replay.anomalies, anomalies).select(
        "anomaly_id", "tick", "kind", "service", "severity", "description", "detector_ord", "ord_1",
        "blast_radius", F.to_json("blast_hops").alias("blast_hops"),
    )
    board = N.active_incidents(replay.board(), incidents).select(
        "incident_id", "started", "last_ts", "state", F.bround("severity", 3).alias("severity"), "root_service",
        "suspected_cause", "services", "impact", F.to_json("impact_hops").alias("impact_hops"), "anomaly_ids",
        "anomaly_kinds", "title", "anomaly_count",
    )
    fired = replay.rule_firings.groupBy("rule_id").agg(
        F.max("fired_count").alias("fired_count"), F.max("tick").alias("last_fired")
    )
    rules = replay.rules.join(fired, "rule_id", "left").withColumn(
        "fired_count", F.coalesce("fired_count", F.lit(0)).cast("bigint")
    )
    moment = kpi(replay).select(F.lit(now).alias("moment"), F.struct("*").alias("kpi"))
    parts = [
        listed(newest_logs(replay, logs), "logs", F.col("ts"), F.col("span_id")),
        listed(shown, "anomalies", F.col("tick"), F.col("detector_ord"), F.col("ord_1")),
        listed(board, "incidents", -F.col("severity"), -F.col("last_ts")),
        listed(nodes, "nodes", F.col("service")),
        listed(edges, "edges", F.col("source"), F.col("target")),
        listed(R.timeline(replay.raw_logs, p, replay.last_ts), "timeline", F.col("ts")),
        listed(rules, "rules", F.col("position")),
    ]
    return reduce(lambda a, b: a.join(b, "moment"), parts, moment)


def write_snapshot(message: DataFrame, path: str) -> None:
    """The live message as one JSON document; call it once per micro-batch."""
    message.write.mode("overwrite").json(path)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest of the documents that a stream has written (``start_snapshots``)."""
    held = spark.read.json(path)
    newest = held.agg(F.max("batch")).first()[0]
    return held.filter(F.col("batch") == F.lit(newest)).drop("batch")
