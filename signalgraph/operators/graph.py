"""The call graph seen in the logs: decaying edges, node state, blast radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalgraph.functions import scalars as S
from signalgraph.functions.ordered import ordered_fold
from signalgraph.operators.rates import last_tick_no
from signalgraph.params import Params
from signalgraph.sources.logs import last_ts, within


def _calls(logs: DataFrame) -> DataFrame:
    """Caller and callee of each row that names both and is no self-call."""
    ends = F.col("parent_service").isNotNull() & (F.col("parent_service") != "") & (F.col("service") != "")
    return logs.filter(ends & (F.col("parent_service") != F.col("service"))).withColumnsRenamed(
        {"parent_service": "source", "service": "target"}
    )


def edge_counts(logs: DataFrame, p: Params, as_of: float | None = None) -> DataFrame:
    """Calls per edge over the last window."""
    as_of = last_ts(logs) if as_of is None else as_of
    rows = within(logs, as_of, p.window_s)
    return _calls(rows).groupBy("source", "target").agg(F.count(F.lit(1)).alias("calls"))


def edge_ticks(logs: DataFrame, p: Params, last: int | None = None) -> DataFrame:
    """Calls per edge in the window of every tick."""
    last = last_tick_no(last_ts(logs), p) if last is None else last
    panes = (
        _calls(logs)
        .groupBy("source", "target", S.bucket_index("ts", p.tick_s).alias("pane"))
        .agg(F.count(F.lit(1)).alias("calls"))
    )
    ticks = F.sequence(
        F.col("pane") + 1, F.least(F.col("pane") + p.ticks_per_window, F.lit(last).cast("bigint"))
    )
    return (
        panes.withColumn("tick_no", F.explode(ticks))
        .groupBy("source", "target", "tick_no")
        .agg(F.sum("calls").alias("calls"))
    )


def edge_weights(edge_calls: DataFrame, numbered: DataFrame, p: Params) -> DataFrame:
    """Weight of every living edge at every tick that holds rows.

    Each tick a weight decays, gains the window's calls and is dropped below the
    floor. ``numbered`` has ``tick_no, tick, seq`` of the ticks that hold rows.
    The fold runs over an edge's ticks with calls; silent ticks after the last
    call are filled in by the same decay until the floor.
    """
    decay, floor = p.edge_decay, p.edge_floor
    last_seq = numbered.agg(F.max("seq")).first()[0] or 0

    def step(state: dict, row: tuple):
        source, target, seq, calls = row
        yield from silent(state, source, target, seq)
        state["weight"] = state.get("weight", 0.0) * decay + calls
        state["seq"] = seq
        if state["weight"] < floor:
            state["weight"] = 0.0
        else:
            yield source, target, seq, state["weight"]

    def silent(state: dict, source: str, target: str, until: int):
        weight = state.get("weight", 0.0)
        for seq in range(state.get("seq", until) + 1, until):
            weight *= decay
            if weight < floor:
                weight = 0.0
                break
            yield source, target, seq, weight
        state["weight"] = weight

    def finish(state: dict, key: tuple):
        yield from silent(state, *key, last_seq + 1)

    calls = edge_calls.join(numbered.select("tick_no", "seq"), "tick_no").select("source", "target", "seq", "calls")
    weights = ordered_fold(
        calls, ["source", "target"], ["seq"], dict, step, "source string, target string, seq long, weight double", finish
    )
    return weights.join(numbered, "seq").select("tick_no", "tick", "source", "target", "weight")


def graph_edges(weights: DataFrame) -> DataFrame:
    """Edges of each tick scaled so that the heaviest is 1."""
    heaviest = weights.groupBy("tick_no").agg(F.max("weight").alias("heaviest"))
    return weights.join(heaviest, "tick_no").select(
        "tick_no", "tick", "source", "target", (F.col("weight") / F.col("heaviest")).alias("weight")
    )


def node_metrics(ticks: DataFrame, p: Params, groups: DataFrame | None = None) -> DataFrame:
    """Load, error rate, latency and health of each service at its ticks.

    ``groups`` (service, grp) names the groups; without it the known ones apply.
    """
    out = ticks.select(
        "tick_no",
        "tick",
        "service",
        S.per_minute("total", p.window_s).alias("logs_per_min"),
        "error_rate",
        F.col("mean_lat").alias("mean_latency_ms"),
        S.health("error_rate", "p95").alias("health"),
    )
    if groups is None:
        return out.withColumn("grp", S.group_of())
    return out.join(groups, "service", "left").withColumn("grp", F.coalesce("grp", F.lit("other")))


NODE_DEFAULTS = {"logs_per_min": 0.0, "error_rate": 0.0, "mean_latency_ms": 0.0, "health": 1.0}


def nodes_at(metrics: DataFrame, edge_calls: DataFrame, as_of_tick_no: int) -> DataFrame:
    """Every node ever seen up to a tick, with its latest values. A service only
    seen as a caller has the defaults of a node without rows."""
    past = metrics.filter(F.col("tick_no") <= as_of_tick_no)
    state = F.max_by(F.struct(*NODE_DEFAULTS), "tick_no").alias("state")
    known = past.groupBy("service").agg(state).select("service", "state.*")
    ends = edge_calls.filter(F.col("tick_no") <= as_of_tick_no).select(
        F.explode(F.array("source", "target")).alias("service")
    )
    return (
        ends.distinct()
        .join(known, "service", "full")
        .select(
            "service",
            S.group_of().alias("grp"),
            *[F.coalesce(c, F.lit(v)).alias(c) for c, v in NODE_DEFAULTS.items()],
        )
    )


def node_history(metrics: DataFrame, numbered: DataFrame) -> DataFrame:
    """Node values at every tick from a service's first on; a tick without rows
    of the service repeats its latest values."""
    lives = Window.partitionBy("service").orderBy("seq")
    last_seq = numbered.agg(F.max("seq")).first()[0] or 0
    known = metrics.join(numbered.select("tick_no", "seq"), "tick_no")
    until = F.coalesce(F.lead("seq").over(lives), F.lit(last_seq + 1)) - 1
    lasting = known.withColumn("until", until).drop("tick_no", "tick")
    filled = lasting.withColumn("seq", F.explode(F.sequence("seq", "until")))
    return filled.join(numbered, "seq").drop("seq", "until")


def topologies(weights: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Which topology each tick has, and the edges of each distinct topology.

    The set of living edges changes rarely, so reachability is worked out once
    per distinct set, not once per tick. A tick's list has one entry per edge.
    """
    alive = weights.filter(F.col("weight") >= p.blast_edge_floor)
    per_tick = alive.groupBy("tick_no").agg(F.array_sort(F.collect_list(F.struct("source", "target"))).alias("edges"))
    per_tick = per_tick.withColumn("topology", F.sha2(F.to_json("edges"), 256))
    distinct = (
        per_tick.groupBy("topology")
        .agg(F.first("edges").alias("edges"))
        .select("topology", F.explode("edges").alias("e"))
        .select("topology", "e.source", "e.target")
    )
    return per_tick.select("tick_no", "topology"), distinct


def reach(edges: DataFrame, depth: int, key: str = "topology") -> DataFrame:
    """Fewest hops from every source to every service it reaches in ``depth``
    steps along ``edges`` (key, source, target); itself at 0 hops."""
    steps = edges.select(key, F.col("source").alias("at"), F.col("target").alias("next"))
    front = edges.select(key, "source", F.col("source").alias("service")).distinct()
    found = front.withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        front = (
            front.join(steps.withColumnRenamed("at", "service"), [key, "service"])
            .select(key, "source", F.col("next").alias("service"))
            .distinct()
        )
        found = found.unionByName(front.withColumn("hops", F.lit(hop)))
    return found.groupBy(key, "source", "service").agg(F.min("hops").alias("hops"))


def blast_radius(reached: DataFrame, key: str = "topology") -> DataFrame:
    """Reached services as an ordered list and a map, one row per source."""
    near = F.array_sort(F.collect_list(F.struct("hops", "service")))
    return reached.groupBy(key, "source").agg(near.alias("near")).select(
        key,
        "source",
        F.col("near.service").alias("blast_radius"),
        F.map_from_entries(F.transform("near", lambda x: F.struct(x["service"], x["hops"]))).alias("blast_hops"),
    )


def neighbours(edges: DataFrame, service: str) -> DataFrame:
    """Edges into a service (upstream) and out of it (downstream)."""
    return edges.filter((F.col("source") == service) | (F.col("target") == service)).withColumn(
        "direction", F.when(F.col("target") == service, "upstream").otherwise("downstream")
    )


def incident_subgraph(incident_impact: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in an incident's impact.

    ``incident_impact`` has incident_id, service, hops, is_root.
    """
    source = incident_impact.select(
        "incident_id", F.col("service").alias("source"), F.col("hops").alias("source_hops"), F.col("is_root").alias("source_is_root")
    )
    target = incident_impact.select(
        "incident_id", F.col("service").alias("target"), F.col("hops").alias("target_hops"), F.col("is_root").alias("target_is_root")
    )
    label = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string"))
    return (
        edges.join(source, "source")
        .join(target, ["incident_id", "target"])
        .withColumn("source_label", label("source_hops"))
        .withColumn("target_label", label("target_hops"))
    )
