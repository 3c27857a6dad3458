"""Structured Streaming versions of the continuous operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from signalgraph.functions import scalars as S
from signalgraph.functions.quantiles import quantile_rollup, value_bin
from signalgraph.operators import rates as R
from signalgraph.operators.detect import rate_anomalies, rate_signals
from signalgraph.operators.templates import clean
from signalgraph.params import Params
from signalgraph.plans.replay import Replay
from signalgraph.plans.views import snapshot, write_snapshot
from signalgraph.sources.adapters import document_logs, event_logs
from signalgraph.sources.logs import append_logs, last_ts, read_logs, retained
from signalgraph.schema import LOG_SCHEMA
from signalgraph.sources.staging import scratch, stage, staged_at
from signalgraph.streaming import live as LV
from signalgraph.streaming import state as ST

LATE_S = 10.0  # rows later than this are dropped
KEY_BUCKETS = 64  # messages and leaves are kept in so many keyed states; fixed for the life of a checkpoint
SLICE_TICKS = 64  # ticks whose new templates are put in order by one task
TRACE_GAP_S = 30.0  # silence after which a trace is taken for whole
FAR_S = 30 * 86400.0  # how far behind a replay's rows its end is marked
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk, as large keyed state needs; applies to queries started later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def timed(logs: DataFrame, late_s: float = LATE_S) -> DataFrame:
    """Adds the event-time column and its watermark."""
    return logs.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1000000).cast("bigint"))).withWatermark(
        "event_time", f"{int(late_s * 1000)} milliseconds"
    )


def _span(seconds: float) -> str:
    return f"{int(seconds * 1000)} milliseconds"


def start_append(
    logs: DataFrame, path: str, checkpoint: str, every: str = "500 milliseconds", source: str = "stream"
) -> StreamingQuery:
    """Stores the stream as the log table. Each micro-batch is one batch of the
    table, named after it, so a retry replaces what the first try wrote."""
    return (
        logs.writeStream.foreachBatch(lambda batch, n: append_logs(batch, path, f"{source}-{n}"))
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def start_table(
    stream: DataFrame, path: str, checkpoint: str, every: str = "2 seconds", fmt: str = "parquet"
) -> StreamingQuery:
    """Appends any of the streams below to a table, at a pace of its own. Each
    query has its own checkpoint, so each sees every record of the source."""
    return (
        stream.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )


def start_snapshots(
    logs: DataFrame, store: str, path: str, checkpoint: str, p: Params, every: str | None = "2 seconds",
    chain: type[Replay] = Replay, source: str = "stream",
) -> StreamingQuery:
    """Stores the stream as the log table and emits the live message after each micro-batch:
    one JSON document per batch id, so a retry replaces what the first try wrote. With
    ``every=None`` it drains the source and ends.

    A message is worked out over the rows of the last ``retention_s``: its cost follows that
    window, not the history, and what was seen only before it counts as unseen. Tables staged
    on the way are deleted with the batch.
    """

    def emit(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        append_logs(batch, store, f"{source}-{n}")
        held = read_logs(spark, store)
        newest = last_ts(held)
        if newest:
            with scratch(spark):
                seen = retained(held, newest, p.retention_s).select(*LOG_SCHEMA.fieldNames())
                write_snapshot(snapshot(chain(stage(seen, "retained"), p)), f"{path}/batch={n}")

    writer = logs.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def counted(logs: DataFrame, name: str = "ingest") -> DataFrame:
    """The same stream; each progress report tells how many rows passed."""
    return logs.observe(name, F.count(F.lit(1)).alias("rows"), F.max("ts").alias("newest_ts"))


def second_counts(logs: DataFrame, p: Params) -> DataFrame:
    """Totals per bucket, as each bucket closes."""
    return (
        timed(logs)
        .groupBy(F.window("event_time", _span(p.bucket_s)))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum(S.flag(S.is_error())).alias("errors"),
            F.sum(S.flag(F.col("level") == "WARN")).alias("warns"),
        )
        .select(F.unix_micros("window.start").alias("start_us"), "total", "errors", "warns")
    )


def sliding_rates(logs: DataFrame, p: Params) -> DataFrame:
    """Per-service counts and exact p95 of every sliding window, as it closes.

    Rows are gathered once, per tick-long pane and service; keyed state holds the panes of
    a service's open windows, so a row is not multiplied by the windows it is in.
    """
    panes = (
        timed(logs)
        .groupBy(F.window("event_time", _span(p.tick_s)).alias("w"), "service")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum(S.flag(S.is_error())).alias("errors"),
            F.sum(S.flag(F.col("level") == "WARN")).alias("warns"),
            F.collect_list(F.col("latency_ms").cast("double")).alias("values"),
        )
        .select(
            F.window_time("w").alias("event_time"),  # a microsecond before the end; later operators go by it
            (F.unix_micros("w.start") / F.lit(p.tick_s * 1000000)).cast("bigint").alias("pane"),
            "service", "total", "errors", "warns", "values",
        )
    )
    return LV.timed_run(panes, ["service"], LV.WindowRates(p)).withColumn("error_rate", S.ratio("errors", "total"))


def _cells(logs: DataFrame, p: Params) -> DataFrame:
    """Counts per pane ``w``, service and latency ``v``."""
    return (
        timed(logs)
        .groupBy(F.window("event_time", _span(p.tick_s)).alias("w"), "service", F.col("latency_ms").alias("v"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum(S.flag(S.is_error())).alias("errors"),
            F.sum(S.flag(F.col("level") == "WARN")).alias("warns"),
        )
    )


def pane_cells(logs: DataFrame, p: Params) -> DataFrame:
    """Counts per tick-long pane, service and latency, as each pane closes.

    Every row is counted once, not once per window it is in; exact window
    quantiles come from the stored cells by ``rates_from_cells``.
    """
    return _cells(logs, p).select(
        (F.unix_micros("w.start") / F.lit(p.tick_s * 1000000)).cast("bigint").alias("pane"),
        "service",
        value_bin("v").alias("bin"),
        "v",
        "total",
        "errors",
        "warns",
    )


def rates_from_cells(cells: DataFrame, p: Params) -> DataFrame:
    """``service_ticks`` from stored cells, up to the newest closed pane."""
    newest = cells.agg(F.max("pane")).first()[0]
    last = 0 if newest is None else newest + 1
    rolled = quantile_rollup(cells, ["service"], ["errors", "warns"], R.LATENCY_PROBS, p.ticks_per_window, last)
    return R.finish_ticks(rolled, p, R.LATENCY_PROBS)


def service_signals(rates: DataFrame, p: Params) -> DataFrame:
    """z-scores and forecast of each service, kept up tick by tick in state."""
    return ST.run(rates, ["service"], ST.ServiceSignals(p), in_time=True)


def rate_anomaly_stream(rates: DataFrame, p: Params) -> DataFrame:
    """Anomaly rows of the rate detector, as ticks close."""
    return rate_anomalies(service_signals(rates, p), p)


def edge_calls(logs: DataFrame, p: Params) -> DataFrame:
    """Calls per edge in every sliding window, as it closes."""
    # rows that are no calls are left out only after counting, as they move the watermark too
    is_call = F.col("parent_service").isNotNull() & (F.col("parent_service") != F.col("service"))
    panes = (
        timed(logs)
        .groupBy(
            F.window("event_time", _span(p.tick_s)).alias("w"),
            F.col("parent_service").alias("source"),
            F.col("service").alias("target"),
        )
        .agg(F.sum(S.flag(is_call)).alias("calls"))
        .filter("calls > 0")
    )
    return (
        panes.groupBy(F.window(F.window_time("w"), _span(p.window_s), _span(p.tick_s)), "source", "target")
        .agg(F.sum("calls").alias("calls"))
        .select(
            F.window_time("window").alias("event_time"),
            (F.unix_micros("window.end") / F.lit(p.tick_s * 1000000)).cast("bigint").alias("tick_no"),
            "source",
            "target",
            "calls",
        )
    )


def edge_signals(logs: DataFrame, p: Params) -> DataFrame:
    """Edge weights at the ticks that saw calls, kept up tick by tick in state."""
    return ST.run(edge_calls(logs, p), ["source", "target"], ST.EdgeDecay(p))


def _one_tenant(df: DataFrame) -> DataFrame:
    return df if "env" in df.columns else df.withColumn("env", F.lit("all"))


def rate_rows(rates: DataFrame, p: Params) -> DataFrame:
    """Rates as rows of the live clock; they also tell which ticks hold rows."""
    return LV.live_rows(
        _one_tenant(rates), "rate", tick_no="tick_no", service="service", total="total", error_rate="error_rate", p95="p95",
        logs_per_min=S.per_minute("total", p.window_s),
    )


def signal_rows(signals: DataFrame, p: Params) -> DataFrame:
    """Signals as rows of the live clock: one for the rates, one for each anomaly in them."""
    rate = F.struct(F.lit("rate").alias("kind"), F.lit(0).alias("sub"), F.lit(0.0).alias("severity"))
    found = F.transform(
        rate_signals(p),
        lambda s: F.struct(F.lit("anomaly").alias("kind"), s["sub"].alias("sub"), S.z_severity(s["z"], p.z_threshold).cast("double").alias("severity")),
    )
    held = _one_tenant(signals).withColumn("x", F.explode(F.concat(F.array(rate), found)))
    return LV.live_rows(
        held, F.col("x.kind"), tick_no="tick_no", service="service", total="total", error_rate="error_rate", p95="p95",
        logs_per_min=S.per_minute("total", p.window_s), sub=F.col("x.sub"), severity=F.col("x.severity"),
    )


def edge_rows(calls: DataFrame) -> DataFrame:
    return LV.live_rows(_one_tenant(calls), "edge", tick_no="tick_no", service="source", target="target", calls="calls")


def change_rows(changes: DataFrame, p: Params) -> DataFrame:
    """A stream of rule changes (``change_ts``, ``change``, the rule's columns) as rows of the
    live clock. A change holds from the first tick at or after its time on."""
    held = _one_tenant(changes).withColumn("event_time", F.timestamp_micros((F.col("change_ts") * 1000000).cast("bigint")))
    return LV.live_rows(
        held, "change", tick_no=F.ceil(F.col("change_ts") / F.lit(p.tick_s)), at="change_ts",
        **{c: c for c in ("rule_id", "change", *LV.BODY)},
    )


def live_rule_firings(rates: DataFrame, p: Params, rules: list[tuple] = (), changes: DataFrame | None = None) -> DataFrame:
    """Firings of ``rules`` (as in ``DEFAULT_RULES``) and of those that a stream of changes
    adds, switches and deletes. Ticks without rows don't break a dwell."""
    rows = rate_rows(rates, p)
    if changes is not None:
        rows = rows.unionByName(change_rows(changes, p))
    return LV.run(rows, LV.RuleClock(p, rules))


def live_graph(logs: DataFrame, p: Params, clock: type[LV.GraphClock] = LV.GraphClock) -> DataFrame:
    """Living edges of every tick, silent ones too; with ``BlastClock`` what services reach."""
    rows = rate_rows(sliding_rates(logs, p), p).unionByName(edge_rows(edge_calls(logs, p)))
    return LV.run(rows, clock(p))


def live_correlation(logs: DataFrame, p: Params) -> DataFrame:
    """The correlation matrix of problem rates every ``correlation_s``, over closed buckets."""
    buckets = (
        timed(logs)
        .groupBy(F.window("event_time", _span(p.bucket_s)).alias("w"), "service")
        .agg(F.count(F.lit(1)).alias("total"), F.sum(S.flag(S.is_problem())).alias("problems"))
        .select(
            F.window_time("w").alias("event_time"),
            (F.unix_micros("w.end") / F.lit(p.bucket_s * 1000000)).cast("bigint").alias("tick_no"),
            "service",
            S.ratio("problems", "total").alias("rate"),
        )
    )
    rows = LV.live_rows(_one_tenant(buckets), "rate", tick_no="tick_no", service="service", error_rate="rate")
    return LV.run(rows, LV.CorrelationClock(p))


def live_incidents(logs: DataFrame, p: Params, rules: list[tuple] = (), changes: DataFrame | None = None) -> DataFrame:
    """Members of incidents and changes of their states, from the logs on: rate and rule
    detectors, the call graph and incidents in one job. ``event`` is member, active,
    resolving, resolved or dropped."""
    rows = signal_rows(service_signals(sliding_rates(logs, p), p), p).unionByName(edge_rows(edge_calls(logs, p)))
    if changes is not None:
        rows = rows.unionByName(change_rows(changes, p))
    return LV.run(rows, LV.IncidentClock(p, rules))


def _mined(messages: DataFrame, p: Params, in_time: bool) -> DataFrame:
    """Template of each message; a blank one has group -1. Branches are kept per token path in
    state, those of all levels together, so that a text is sent once to find its leaf and once
    to its groups."""
    words = F.when(F.col("masked") == "", 0).otherwise(F.size(F.split("masked", " ")))
    bucket = F.pmod(F.xxhash64("leaf"), F.lit(KEY_BUCKETS))
    wide = messages.withColumn("leaf", words.cast("string")).withColumn("bucket", bucket)
    routed = ST.run(wide, ["bucket"], ST.Branch(p.template_depth, p.template_children), in_time)
    leaves = ST.run(routed.withColumn("bucket", bucket), ["bucket"], ST.Leaf(p.template_similarity), in_time)
    return leaves.withColumn("template_id", F.xxhash64("leaf", "grp"))


def template_signals(logs: DataFrame, p: Params) -> DataFrame:
    """Each record's template, mined as records arrive. Templates are named by leaf and
    place in the leaf."""
    at = F.timestamp_micros((F.col("ts") * 1000000).cast("bigint")).alias("event_time")
    messages = logs.select(at, "ts", "span_id", "service", clean().alias("masked")).filter("masked <> ''")
    return _mined(messages, p, False).drop("event_time")


def first_sights(logs: DataFrame, p: Params, forget_s: float) -> DataFrame:
    """The first record of each masked message, as its tick closes. Records are combined per
    tick and message first, so that a common message is one row a tick."""
    panes = (
        timed(logs)
        .withColumn("masked", clean())
        .groupBy(F.window("event_time", _span(p.tick_s)).alias("w"), "masked")
        .agg(F.min(F.struct("ts", "span_id", "service")).alias("first"))
        .select(F.window_time("w").alias("event_time"), "first.*", "masked", F.pmod(F.xxhash64("masked"), F.lit(KEY_BUCKETS)).alias("bucket"))
    )
    return LV.timed_run(panes, ["bucket"], LV.FirstSights(forget_s))


def live_new_templates(logs: DataFrame, p: Params, forget_s: float = 86400.0) -> DataFrame:
    """New templates after the warm-up, as ticks close. Only messages not seen before (or not
    for ``forget_s``) go through the miner, in order of event time."""
    tick_no = F.floor(F.col("ts") / F.lit(p.tick_s)) + 1
    found = (
        _mined(first_sights(logs, p, forget_s), p, True)
        .filter("is_new or (masked = '' and service <> '')")  # a blank message may be the first of all
        .select(
            "event_time", F.floor(tick_no / F.lit(SLICE_TICKS)).alias("slice"), tick_no.alias("tick_no"), "ts",
            F.coalesce("span_id", F.lit("")).alias("span_id"), F.nullif("service", F.lit("")).alias("service"), "masked", "is_new",
        )
    )
    placed = LV.timed_run(found, ["slice"], LV.SliceOrder())
    keyed = placed.withColumn("of", F.when(F.col("is_count"), 0).otherwise(F.col("slice")))
    return LV.timed_run(LV.timed_run(keyed, ["is_count", "of"], LV.SliceStart()), ["slice"], LV.SliceNumbers(p))


def live_outliers(rates: DataFrame, p: Params) -> DataFrame:
    """Decision value and flag of each service, by a forest grown as its tick closes."""
    held = _one_tenant(rates).select("event_time", "env", "tick_no", "tick", "service", *[F.col(c).cast("double").alias(c) for c in R.FEATURES])
    return LV.timed_run(held, ["env", "tick_no"], LV.TickForest(p))


def live_traces(logs: DataFrame, gap_s: float = TRACE_GAP_S) -> DataFrame:
    """Summary of each trace, and its spans with their depth, once it has been silent for
    ``gap_s``. A trace that goes on later is told as another."""
    end = F.col("ts") + F.col("latency_ms") / 1000.0
    span = F.struct("ts", "span_id", "parent_service", "service")
    closed = (
        timed(logs)
        .groupBy(F.session_window("event_time", _span(gap_s)).alias("w"), "trace_id")
        .agg(
            F.min("ts").alias("started"),
            ((F.max(end) - F.min("ts")) * 1000.0).alias("duration_ms"),
            F.array_sort(F.collect_set("service")).alias("services"),
            F.max(S.is_error()).alias("has_errors"),
            F.count(F.lit(1)).alias("spans"),
            F.array_sort(F.collect_list(span)).alias("rows"),
        )
    )
    return closed.withColumn("depths", span_depths()("rows.service", "rows.parent_service"))


def trace_span_depths(traces: DataFrame) -> DataFrame:
    """trace_id, span_id, service, depth of ``live_traces``."""
    each = F.explode(F.arrays_zip(F.col("rows.span_id").alias("span_id"), F.col("rows.service").alias("service"), F.col("depths").alias("depth")))
    return traces.select("trace_id", each.alias("s")).select("trace_id", "s.span_id", "s.service", "s.depth")


def span_depths():
    """Column function of the services and parents of a trace's spans in order: how deep each is."""

    @F.arrow_udf("array<int>")
    def depths(services: pa.Array, parents: pa.Array) -> pa.Array:
        out = []
        for own, above in zip(services.to_pylist(), parents.to_pylist()):
            level: dict[str, int] = {}  # of a service, by its first span
            row = []
            for service, parent in zip(own, above):
                row.append(level.get(parent, 0))
                level.setdefault(service, row[-1] + 1)
            out.append(row)
        return pa.array(out, pa.list_(pa.int32()))

    return depths


def incident_signals(anomalies: DataFrame, p: Params, by: str = "env") -> DataFrame:
    """The incident of each anomaly, as anomalies arrive, per tenant."""
    return ST.run(anomalies, [by], ST.IncidentFold(p))


def _table_stream(spark: SparkSession, folder: str, name: str, view: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table as a stream of logs that ends: a row far behind the last one, of no service,
    moves the watermark past all windows, so that a drained replay closes them."""
    path = f"{folder}/{name}.parquet"
    held = spark.read.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(held.schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = reader.parquet(path)
    else:
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    end = view(held).agg(F.max("ts").alias("ts"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields if f.name != "ts"]
    marker = stage(end.select((F.col("ts") + FAR_S).alias("ts"), *empty), "end_of_stream")
    ending = spark.readStream.schema(marker.schema).parquet(marker.inputFiles()[0].rsplit("/", 1)[0])
    logs = view(stream).drop("event_time")
    return logs.unionByName(ending.select(*logs.columns))


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _table_stream(spark, folder, "events", event_logs)


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Drains what the source holds now into a staged table and reads it."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    place = staged_at(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{place}/out")
        .option("checkpointLocation", f"{place}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def _until_last(spark: SparkSession, folder: str, out: DataFrame, p: Params) -> DataFrame:
    """Without the windows that end after the last tick of the table."""
    last = R.last_tick_no(last_ts(event_logs(spark.read.parquet(f"{folder}/events.parquet"))), p)
    return out.filter(F.col("tick_no") <= last)


def replay_window_rates(spark: SparkSession, folder: str, p: Params) -> DataFrame:
    cells = run_once(pane_cells(_event_stream(spark, folder), p), "cells")
    return rates_from_cells(cells, p)


def replay_signals(spark: SparkSession, folder: str, p: Params) -> DataFrame:
    """z-scores and forecast of every tick."""
    rates = sliding_rates(_event_stream(spark, folder), p)
    return _until_last(spark, folder, run_once(service_signals(rates, p), "signals"), p)


def replay_rate_anomalies(spark: SparkSession, folder: str, p: Params) -> DataFrame:
    """The rate detector over the stream, up to anomaly rows."""
    rates = sliding_rates(_event_stream(spark, folder), p)
    return _until_last(spark, folder, run_once(rate_anomaly_stream(rates, p), "anomalies"), p)


def replay_rule_firings(spark: SparkSession, folder: str, rules: list[tuple], p: Params, changes: DataFrame | None = None) -> DataFrame:
    """``rules``, or the rules of a change table that is read as a stream beside the logs."""
    rates = sliding_rates(_event_stream(spark, folder), p)
    if changes is not None:
        held = stage(changes, "rule_changes")
        changes = spark.readStream.schema(held.schema).parquet(held.inputFiles()[0].rsplit("/", 1)[0])
    return _until_last(spark, folder, run_once(live_rule_firings(rates, p, rules, changes), "firings"), p)


def replay_traces(spark: SparkSession, folder: str, gap_s: float) -> DataFrame:
    return run_once(live_traces(_event_stream(spark, folder), gap_s).drop("w"), "traces")


def replay_outliers(spark: SparkSession, folder: str, p: Params) -> DataFrame:
    rates = sliding_rates(_event_stream(spark, folder), p)
    return _until_last(spark, folder, run_once(live_outliers(rates, p), "outliers"), p)


def replay_new_templates(spark: SparkSession, folder: str, p: Params, forget_s: float = 86400.0) -> DataFrame:
    """New templates over the lines of documents."""
    return run_once(live_new_templates(_table_stream(spark, folder, "documents", document_logs), p, forget_s), "new_templates")


def replay_graph(spark: SparkSession, folder: str, p: Params, clock: type[LV.GraphClock] = LV.GraphClock) -> DataFrame:
    """Edges, or what services reach, at every tick that holds rows."""
    return _until_last(spark, folder, run_once(live_graph(_event_stream(spark, folder), p, clock), "graph"), p)


def replay_incidents(spark: SparkSession, folder: str, rules: list[tuple], p: Params) -> DataFrame:
    return _until_last(spark, folder, run_once(live_incidents(_event_stream(spark, folder), p, rules), "incidents"), p)


def replay_correlation(spark: SparkSession, folder: str, p: Params) -> DataFrame:
    """The matrix at every moment up to the last row."""
    last = last_ts(event_logs(spark.read.parquet(f"{folder}/events.parquet")))
    return run_once(live_correlation(_event_stream(spark, folder), p), "correlation").filter(F.col("moment") <= last)


def replay_edge_weights(spark: SparkSession, folder: str, p: Params) -> DataFrame:
    """Weights at the ticks that saw calls."""
    return _until_last(spark, folder, run_once(edge_signals(_event_stream(spark, folder), p), "edges"), p)


def replay_seconds(spark: SparkSession, folder: str, p: Params) -> DataFrame:
    return run_once(second_counts(_event_stream(spark, folder), p), "seconds")
