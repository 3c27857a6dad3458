"""Named queries over the driver's tables: one per operator.

Logs are a view of ``events`` (or of another table where the name says so), with
every duration stretched 1800 times, because events are minutes apart. Doubles
are rounded here, not in the operators, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalgraph.operators import detect as D
from signalgraph.operators import forecast as E
from signalgraph.operators import graph as G
from signalgraph.operators import iforest as I
from signalgraph.operators import incidents as N
from signalgraph.operators import rates as R
from signalgraph.operators import reads
from signalgraph.operators import rules as U
from signalgraph.operators import templates as M
from signalgraph.operators import traces as TR
from signalgraph.params import Params
from signalgraph.plans import views as V
from signalgraph.plans.replay import Replay
from signalgraph.sources import adapters as A
from signalgraph.sources import logs as L
from signalgraph.sources.staging import stage
from signalgraph.streaming import jobs as J
from signalgraph.streaming import live as LV

STRETCH = 1800
P = Params().scaled(STRETCH)
# lineitem spans seven years of whole days
P_LINES = Params(window_s=30 * 86400.0, tick_s=86400.0, bucket_s=86400.0)

# id, position, name, service, metric, op, threshold, duration in seconds, enabled
RULES = [
    ("r_err_any", 1, "error rate anywhere", "*", "error_rate", ">", 0.3, 7200.0, True),
    ("r_pay_p95", 2, "payments p95", "payments", "p95_latency", ">=", 150.0, 7200.0, True),
    ("r_ntf_load", 3, "notifications load", "notifications", "logs_per_min", ">", 0.02, 7200.0, True),
    ("r_quiet", 4, "ledger quiet", "ledger", "logs_per_min", "<", 0.012, 3600.0, True),
    ("r_off", 5, "never looked at", "*", "error_rate", "<=", 1.0, 0.0, False),
]
_DAY = 86400.0
_T0 = 1704067200.0  # start of the events
# change_ts, rule_id, change, then the rule's columns for adds
RULE_CHANGES = [
    (_T0, "r_err_any", "add", 1, "error rate anywhere", "*", "error_rate", ">", 0.3, 7200.0),
    (_T0 + 5 * _DAY, "r_err_any", "disable", None, None, None, None, None, None, None),
    (_T0 + 8 * _DAY, "r_err_any", "enable", None, None, None, None, None, None, None),
    (_T0 + 10 * _DAY, "r_ntf_load", "add", 2, "notifications load", "notifications", "logs_per_min", ">", 0.02, 7200.0),
    (_T0 + 20 * _DAY, "r_err_any", "delete", None, None, None, None, None, None, None),
]
CHANGE_SCHEMA = (
    "change_ts double, rule_id string, change string, position int, name string, service string, "
    "metric string, op string, threshold double, duration_s double"
)


def near(c: str | Column) -> Column:
    """Six digits; the nudge keeps exact ties from hanging on the last bit."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col + F.lit(1e-9), 6)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """All double columns rounded, but those in ``keep``."""
    return df.select(
        *[
            near(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) and f.name not in keep else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return A.event_logs(A.table(spark, folder, "events"))


_replays: dict[tuple, Replay] = {}


def _version(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Size, number of files and time of change of a table's folder or file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getContentSummary(at)
    return held.getLength(), held.getFileCount(), fs.getFileStatus(at).getModificationTime()


def replay(spark: SparkSession, folder: str) -> Replay:
    """The replay of a folder's events. Its staged tables serve all queries of a
    session until the events change."""
    key = (spark.sparkContext.applicationId, folder, _version(spark, f"{folder}/events.parquet"))
    if key not in _replays:
        _replays[key] = Replay(events(spark, folder), P, U.rules_frame(spark, RULES))
    return _replays[key]


def forget() -> None:
    """Lets the next query of each folder start from its tables again."""
    _replays.clear()


def on_logs(fn: Callable[[DataFrame], DataFrame], *keep: str):
    return lambda spark, folder: rounded(fn(events(spark, folder)), "ts", "tick", "started", "latest", *keep)


def on_replay(fn: Callable[[Replay], DataFrame], *keep: str):
    return lambda spark, folder: rounded(
        fn(replay(spark, folder)), "ts", "tick", "started", "last_ts", "entered_at", "dwell_s", *keep
    )


def joined(df: DataFrame, *lists: str) -> DataFrame:
    """Lists as comma-separated text."""
    return df.withColumns({c: F.array_join(c, ",") for c in lists})


def _trace_summary(logs):
    return joined(TR.trace_summary(logs), "services").withColumn("duration_ms", F.round("duration_ms", 2))


def _neighbours(logs):
    edges = G.edge_counts(logs, P)
    return G.neighbours(edges, "catalog")


def _graph_edges(r: Replay):
    return G.graph_edges(r.edge_weights).select("tick_no", "source", "target", "weight")


def _blast(r: Replay):
    per_tick, edges = r.topologies
    reached = G.reach(edges, P.blast_depth)
    return per_tick.join(reached, "topology").select("tick_no", "source", "service", F.col("hops").cast("bigint").alias("hops"))


def _node_history(r: Replay):
    return G.node_history(r.node_metrics, r.numbered).select(
        "tick_no", "service", "grp", "logs_per_min", "error_rate", "mean_latency_ms", "health"
    )


def _nodes_now(r: Replay):
    return V.graph_snapshot(r)[0]


def _signals(r: Replay):
    return R.zscores(r.ticks, P).select("tick_no", "service", "samples", "z_total", "z_errors", "z_p95")


def _rate_anomalies(r: Replay):
    found = D.rate_anomalies(R.zscores(r.ticks, P), P)
    return found.select("tick_no", "service", F.col("ord_3").cast("bigint").alias("signal"), "severity")


def _rule_eval(r: Replay):
    found = U.rule_dwell(U.rule_matches(r.ticks, r.rules, P), r.numbered)
    return found.select("rule_id", "tick_no", "service", "value", "entered_at", "dwell_s")


def _firings(found: DataFrame) -> DataFrame:
    return found.select("rule_id", "tick_no", "service", "fired_count", "severity")


def _rule_firings(r: Replay):
    return _firings(r.rule_firings)


def _rule_firings_by_service(r: Replay):
    matches = U.rule_matches(r.ticks, r.rules, P, per_service=True)
    return _firings(U.rule_firings(U.rule_dwell(matches, r.numbered))).withColumnRenamed("fired_count", "nth")


def _rule_firings_changed(r: Replay):
    changes = r.spark.createDataFrame(RULE_CHANGES, CHANGE_SCHEMA)
    matches = U.rule_matches(r.ticks, U.rule_versions(changes), P)
    return _firings(U.rule_firings(U.rule_dwell(matches, r.numbered)))


def _forecast(spark, folder):
    ticks = R.service_ticks(events(spark, folder), P, ())
    return rounded(E.forecast(ticks, P).select("tick_no", "service", "forecast", "stddev"))


def _forecast_now(spark, folder):
    return rounded(E.forecast_now(R.service_ticks(events(spark, folder), P, ()), P))


def _masked(logs):
    return M.masked_messages(logs).select("masked", "n", "first_ts", "first_service")


def _templates(r: Replay):
    return r.templates.select("template_id", "template", "count", "first_ts", "first_service")


def _template_log_counts(r: Replay):
    return r.logs.groupBy("template_id", "service", "level").agg(F.count(F.lit(1)).alias("n"))


def _explorer(r: Replay):
    return M.template_explorer(r.logs, P)


def _top_templates(r: Replay):
    return M.top_templates_by_service(r.logs, P).withColumn("place", F.col("place").cast("bigint"))


def _new_templates(r: Replay):
    return M.new_templates(r.templates, P, r.started).select("tick_no", "tick", "template_id", "service")


def _document_new_templates(spark, folder):
    """Ids of documents stand for seconds here, so the warm-up is a live one."""
    logs = A.document_logs(A.table(spark, folder, "documents"))
    templates, _ = M.mine_templates(logs, Params())
    return M.new_templates(templates, Params(), L.first_ts(logs)).select("tick_no", "tick", "template_id", "service", "first_text")


def _anomalies(r: Replay):
    return joined(
        r.anomalies.select("anomaly_id", "tick", "kind", "service", "severity", "description", "blast_radius"), "blast_radius"
    )


def _members(r: Replay):
    return r.members.select("anomaly_id", "tick", "service", "incident_id")


def _steady_found(r: Replay) -> DataFrame:
    return D.all_anomalies(
        D.rate_anomalies(R.zscores(r.ticks, P), P),
        D.rule_anomalies(r.rule_firings),
    )


def _steady_members(r: Replay) -> DataFrame:
    """Incidents of the repeatable detectors only: no forest."""
    with_blast = stage(D.with_blast_radius(_steady_found(r), r.topologies[0], r.blast), "steady")
    return stage(N.assign_incidents(with_blast, P), "steady_members")


def _steady_anomalies(r: Replay):
    return joined(
        D.with_blast_radius(_steady_found(r), r.topologies[0], r.blast).select(
            "tick_no", "kind", "service", "severity", "description", "blast_radius"
        ),
        "blast_radius",
    )


def _steady_shown(r: Replay):
    members = _steady_members(r)
    first = members.groupBy("incident_id").agg(F.min(F.struct(*D.ORDER, "tick_no", "service")).alias("first"))
    return members.join(first, "incident_id").select(
        "tick_no", "kind", "service", "ord_3", F.col("first.tick_no").alias("first_tick_no"), F.col("first.service").alias("first_service")
    )


def _steady_roots(r: Replay):
    members = _steady_members(r)
    ranked = N.root_ranking(members, r.topologies[0], r.root_reach, P)
    started = members.groupBy("incident_id").agg(F.min(F.struct(*D.ORDER, "tick_no")).alias("first"))
    return ranked.join(started, "incident_id").select(
        F.col("first.tick_no").alias("first_tick_no"), "service", "reached_by", "score", F.col("place").cast("bigint").alias("place")
    )


def _rate_incidents(r: Replay):
    records = N.incident_records(_steady_members(r), r.topologies[0], r.root_reach, P)
    return joined(
        records.select("started", "last_ts", "severity", "services", "impact", "anomaly_count", "root_service", "title"),
        "services",
        "impact",
    )


def _steady_board(r: Replay):
    """The board halfway through the history and at its end, with the incident to show first."""
    members, ticks = _steady_members(r), r.numbered.agg(F.min("tick_no"), F.max("tick_no")).first()
    boards = []
    for tick_no in ((ticks[0] + ticks[1]) // 2, ticks[1]):
        as_of = tick_no * P.tick_s
        known = members.filter(F.col("tick") <= as_of)  # later signals are not known yet
        board = N.incident_board(N.incident_records(known, r.topologies[0], r.root_reach, P), as_of, P)
        shown = N.focus_incident(board).select("incident_id", F.lit(True).alias("focus"))
        unresolved = N.active_count(board)
        boards.append(
            board.join(shown, "incident_id", "left")
            .crossJoin(F.broadcast(unresolved))  # one row
            .select(
                F.lit(tick_no).cast("bigint").alias("tick_no"), "state", "started", "last_ts", "severity", "services", "anomaly_count",
                F.coalesce("focus", F.lit(False)).alias("focus"), "active_incidents",
            )
        )
    return joined(boards[0].union(boards[1]), "services")


def _steady_subgraph(r: Replay):
    """Edges of the last tick with both ends in the impact of an incident of the repeatable detectors."""
    members = _steady_members(r)
    roots = N.root_ranking(members, r.topologies[0], r.root_reach, P).filter("place = 1").select("incident_id", F.col("service").alias("root"))
    first = members.groupBy("incident_id").agg(F.min(F.struct(*D.ORDER, "tick_no")).alias("first"))
    impact = N.incident_impact(members).join(roots, "incident_id").withColumn("is_root", F.col("service") == F.col("root"))
    return G.incident_subgraph(impact, V.graph_snapshot(r)[1]).join(first, "incident_id").select(
        F.col("first.tick_no").alias("first_tick_no"), "source", "target", "weight", "source_label", "target_label", "source_is_root", "target_is_root"
    )


def _incidents(r: Replay):
    return joined(
        r.incidents.drop("impact_hops"),
        "services",
        "impact",
        "anomaly_ids",
        "anomaly_kinds",
    )


def _root_cause(r: Replay):
    return N.root_ranking(r.members, r.topologies[0], r.root_reach, P)


def _board(r: Replay):
    return N.panel_order(r.board()).select("incident_id", "state", "severity", "root_service", "title", "last_ts")


def _focus(r: Replay):
    return N.focus_incident(r.board()).select("incident_id", "state", "severity", "root_service", "title")


def _subgraph(r: Replay):
    impact = N.incident_impact(r.members).join(r.incidents.select("incident_id", "root_service"), "incident_id")
    impact = impact.withColumn("is_root", F.col("service") == F.col("root_service"))
    return G.incident_subgraph(impact, V.graph_snapshot(r)[1])


def _anomaly_load(r: Replay):
    steady = D.rate_anomalies(R.zscores(r.ticks, P), P)
    return D.anomaly_load(steady, r.numbered, P).select("tick_no", "anomalies_recent")


def _outliers(r: Replay):
    return r.forest.filter("is_outlier").select("tick_no", "service", "decision")


def _flag_counts(r: Replay):
    """Trees are random, how many rows they flag is not: it follows from the contamination
    and the number of services, unless the scores at the border are tied."""
    k = F.floor((F.col("services") - 1) * P.contamination).cast("int") + 1
    return (
        r.forest.groupBy("tick_no")
        .agg(
            F.count(F.lit(1)).alias("services"),
            F.count(F.when(F.col("is_outlier"), 1)).alias("flagged"),
            F.sort_array(F.collect_list("decision")).alias("scores"),
        )
        .select("tick_no", "services", ((F.col("flagged") == k) | (F.get("scores", k - 1) == F.get("scores", k))).alias("as_asked"))
    )


def _trace(logs):
    """One trace whole: its spans in order with depth, and its summary."""
    chosen = reads.recent_traces(logs, P, limit=1).select("trace_id")
    mine = logs.join(F.broadcast(chosen), "trace_id")  # one row
    spans = TR.trace_depth(mine).select("trace_id", "span_id", "service", "parent_service", "ts", "latency_ms", "level", "depth")
    whole = spans.join(_trace_summary(mine).select("trace_id", "started", "duration_ms", "services", "has_errors"), "trace_id")
    return whole.withColumn("depth", F.col("depth").cast("bigint"))


def _pooled(r: Replay):
    return I.pooled_forest(R.feature_matrix(r.ticks), ["tick_no", "service"], P).filter("is_outlier")


def _metrics(r: Replay):
    samples = V.metrics(V.kpi(r), reads.inserted_total(r.raw_logs), R.service_rates(r.raw_logs, P, r.last_ts))
    return V.metrics_text(samples)


def _service_metrics(logs):
    """The per-service half of the export; the rest depends on the forest."""
    rates = R.service_rates(logs, P)
    empty = logs.sparkSession.range(0).select(
        F.lit(0).alias("logs_per_sec"), F.lit(0).alias("error_rate"), F.lit(0).alias("active_incidents"), F.lit(0).alias("templates_tracked")
    )
    samples = V.metrics(empty, reads.inserted_total(logs), rates)
    return V.metrics_text(samples).filter("part = 2").select("line")


def _kpi_counts(logs):
    p, as_of = P, L.last_ts(logs)
    line = R.timeline(logs, p, as_of)
    return line.agg(
        (F.sum("total") / p.window_s).alias("logs_per_sec"),
        (F.sum("errors") / F.greatest(F.sum("total"), F.lit(1))).alias("error_rate"),
    )


def _detail(r: Replay):
    detail = V.service_detail(r)
    lists = [f.name for f in detail.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return detail.withColumns({c: F.to_json(c) for c in lists})


def _detail_core(r: Replay):
    """The scalar part of the service detail."""
    return V.service_detail(r).select(
        "service", "grp", "logs_per_min", "error_rate", "forecast_error_rate", "forecast_stddev", F.size("latency_series").cast("bigint").alias("points"),
        F.size("top_templates").cast("bigint").alias("templates"), F.size("recent_errors").cast("bigint").alias("problems"),
    )


def _snapshot(r: Replay):
    whole = V.snapshot(r)
    return whole.select("moment", F.to_json(F.struct([c for c in whole.columns if c != "moment"])).alias("message"))


def _line_rates(spark, folder):
    logs = A.lineitem_logs(A.table(spark, folder, "lineitem"))
    return rounded(R.service_ticks(logs, P_LINES), "tick")


def _line_edges(spark, folder):
    logs = A.lineitem_logs(A.table(spark, folder, "lineitem"))
    return G.edge_ticks(logs, P_LINES)


def _line_traces(spark, folder):
    return _trace_summary(A.lineitem_logs(A.table(spark, folder, "lineitem")))


def _line_depth(spark, folder):
    found = TR.trace_depth(A.lineitem_logs(A.table(spark, folder, "lineitem")))
    return found.groupBy("service", "depth").agg(F.count(F.lit(1)).alias("n"))


def _mined(logs: DataFrame) -> DataFrame:
    templates, _ = M.mine_templates(logs, P)
    return templates.select("template_id", "template", "count", "first_text")


def _conversation_templates(spark, folder):
    return _mined(A.conversation_logs(A.table(spark, folder, "conversations")))


def _document_templates(spark, folder):
    return _mined(A.document_logs(A.table(spark, folder, "documents")))


def _document_masks(spark, folder):
    logs = A.document_logs(A.table(spark, folder, "documents"))
    return M.masked_messages(logs).select(F.md5("masked").alias("masked_md5"), "n", "first_ts")


def _stream_rule_firings(spark, folder):
    return rounded(_firings(J.replay_rule_firings(spark, folder, RULES, P)))


def _stream_rule_changes(spark, folder):
    changes = spark.createDataFrame(RULE_CHANGES, CHANGE_SCHEMA)
    return rounded(_firings(J.replay_rule_firings(spark, folder, [], P, changes)))


def _stream_members(spark, folder):
    found = J.replay_incidents(spark, folder, RULES, P).filter("event = 'member'")
    return found.select("tick_no", "kind", "service", "ord_3", "first_tick_no", F.col("first_service"))


def _stream_incident_states(spark, folder):
    """Each change of an incident's state, at the tick that sees it."""
    found = J.replay_incidents(spark, folder, RULES, P).filter("event <> 'member'")
    return found.select("tick_no", F.col("event").alias("state"), "first_tick_no", "first_kind", "first_service", "first_3")


def _stream_trace_summary(spark, folder):
    found = J.replay_traces(spark, folder, J.TRACE_GAP_S * STRETCH).drop("rows", "depths")
    return rounded(joined(found, "services").withColumn("duration_ms", F.round("duration_ms", 2)), "started", "duration_ms")


def _stream_trace_depth(spark, folder):
    found = J.trace_span_depths(J.replay_traces(spark, folder, J.TRACE_GAP_S * STRETCH))
    return found.select("span_id", F.col("depth").cast("bigint").alias("depth"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "service_rates_asof": on_logs(lambda x: R.service_rates(x, P)),
    "service_rates_ticks": on_logs(lambda x: R.service_ticks(x, P)),
    "feature_matrix": on_logs(lambda x: R.feature_matrix(R.service_rates(x, P))),
    "timeline": on_logs(lambda x: R.timeline(x, P)),
    "latency_series": on_logs(lambda x: R.latency_series(x, P)),
    "error_rate_series": on_logs(lambda x: R.error_rate_series(x, P)),
    "search_logs": on_logs(lambda x: reads.search_logs(x, P, "ERROR hand_ed%k"), "latency_ms"),
    "search_total": on_logs(lambda x: reads.search_total(x, P, "took 1", level="WARN", service="*")),
    "recent_traces": on_logs(lambda x: reads.recent_traces(x, P, errors_only=True)),
    "recent_problems": on_logs(lambda x: reads.recent_problems(x, P).drop("template_id"), "latency_ms"),
    "recent_logs": on_logs(lambda x: reads.recent_logs(x).drop("template_id"), "latency_ms"),
    "services": on_logs(reads.services),
    "inserted_total": on_logs(reads.inserted_total),
    "retention": on_logs(lambda x: L.retained(x, L.last_ts(x), P.retention_s).select("ts", "span_id", "service")),
    "trace_summary": on_logs(_trace_summary, "duration_ms"),
    "trace_waterfall": on_logs(TR.trace_waterfall),
    "trace_depth": on_logs(lambda x: TR.trace_depth(x).select("span_id", F.col("depth").cast("bigint").alias("depth"))),
    "trace": on_logs(_trace, "duration_ms", "latency_ms"),
    "edge_counts": on_logs(lambda x: G.edge_counts(x, P)),
    "edge_ticks": on_logs(lambda x: G.edge_ticks(x, P)),
    "neighbours": on_logs(_neighbours),
    "edge_weights": on_replay(lambda r: r.edge_weights),
    "graph_edges": on_replay(_graph_edges),
    "blast_radius": on_replay(_blast),
    "node_history": on_replay(_node_history),
    "graph_nodes": on_replay(_nodes_now),
    "zscore_signals": on_replay(_signals),
    "rate_anomalies": on_replay(_rate_anomalies),
    "anomaly_load": on_replay(_anomaly_load),
    "rule_eval": on_replay(_rule_eval),
    "rule_firings": on_replay(_rule_firings),
    "rule_firings_by_service": on_replay(_rule_firings_by_service),
    "rule_firings_changed": on_replay(_rule_firings_changed),
    "forecast": _forecast,
    "forecast_now": _forecast_now,
    "correlation": on_replay(lambda r: r.correlation().withColumn("corr", F.round(F.col("corr") + 1e-9, 3))),
    "masked_messages": on_logs(_masked, "first_ts"),
    "templates": on_replay(_templates, "first_ts"),
    "template_total": on_replay(lambda r: M.template_total(r.templates)),
    "template_assignment": on_replay(_template_log_counts),
    "template_explorer": on_replay(_explorer, "first_seen", "last_seen"),
    "top_templates": on_replay(_top_templates, "first_seen", "last_seen"),
    "new_templates": on_replay(_new_templates),
    "iforest_outliers": on_replay(_outliers),
    "iforest_flag_counts": on_replay(_flag_counts),
    "iforest_pooled": on_replay(_pooled),
    "anomalies": on_replay(_anomalies),
    "incident_members": on_replay(_members),
    "steady_anomalies": on_replay(_steady_anomalies),
    "steady_members": on_replay(_steady_shown),
    "steady_roots": on_replay(_steady_roots),
    "steady_board": on_replay(_steady_board),
    "steady_subgraph": on_replay(_steady_subgraph),
    "rate_incidents": on_replay(_rate_incidents),
    "incidents": on_replay(_incidents),
    "root_cause": on_replay(_root_cause),
    "incident_board": on_replay(_board),
    "focus_incident": on_replay(_focus),
    "incident_subgraph": on_replay(_subgraph),
    "kpi": on_replay(V.kpi),
    "kpi_counts": on_logs(_kpi_counts),
    "metrics_export": on_replay(_metrics),
    "service_metrics": on_logs(_service_metrics),
    "service_detail": on_replay(_detail),
    "service_detail_core": on_replay(_detail_core),
    "snapshot": on_replay(_snapshot, "moment"),
    "line_service_rates": _line_rates,
    "line_edge_ticks": _line_edges,
    "line_trace_summary": _line_traces,
    "line_trace_depth": _line_depth,
    "conversation_templates": _conversation_templates,
    "document_templates": _document_templates,
    "document_new_templates": _document_new_templates,
    "document_masks": _document_masks,
    "stream_service_rates": lambda spark, folder: rounded(J.replay_window_rates(spark, folder, P), "tick"),
    "stream_forecast": lambda spark, folder: rounded(
        J.replay_signals(spark, folder, P).select("tick_no", "service", "z_total", "z_errors", "z_p95", "forecast", "stddev")
    ),
    "stream_rate_anomalies": lambda spark, folder: rounded(
        J.replay_rate_anomalies(spark, folder, P).select("tick_no", "kind", "service", "severity", "description")
    ),
    "stream_rule_firings": _stream_rule_firings,
    "stream_edge_weights": lambda spark, folder: rounded(
        J.replay_edge_weights(spark, folder, P).select("tick_no", "source", "target", "weight")
    ),
    "stream_trace_summary": _stream_trace_summary,
    "stream_trace_depth": _stream_trace_depth,
    "stream_outliers": lambda spark, folder: rounded(
        J.replay_outliers(spark, folder, P).filter("is_outlier").select("tick_no", "service", "decision")
    ),
    "stream_new_templates": lambda spark, folder: J.replay_new_templates(spark, folder, Params()),
    "stream_rule_changes": _stream_rule_changes,
    "stream_graph": lambda spark, folder: rounded(J.replay_graph(spark, folder, P), "tick"),
    "stream_blast_radius": lambda spark, folder: J.replay_graph(spark, folder, P, LV.BlastClock),
    "stream_correlation": lambda spark, folder: rounded(J.replay_correlation(spark, folder, P), "moment"),
    "stream_incidents": _stream_members,
    "stream_incident_states": _stream_incident_states,
    "stream_seconds": lambda spark, folder: J.replay_seconds(spark, folder, P),
}
