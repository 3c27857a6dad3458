"""Grouping anomalies into incidents, their state over time and root cause."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgraph.functions import scalars as S
from signalgraph.functions.ordered import chain_by_gap, ordered_fold
from signalgraph.operators.detect import ORDER
from signalgraph.params import Params
from signalgraph.sources.staging import stage


class OpenIncidents:
    """Incidents that can still take an anomaly, oldest first."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, anomaly_id: str, ts: float, service: str, blast: list[str], gap: float) -> str:
        """The incident the anomaly joins or opens, named by its first anomaly."""
        self.rows = [r for r in self.rows if ts - r["last_ts"] <= gap]
        reached = set(blast)
        best, best_score = None, 0.0
        for r in self.rows:
            score = (
                3.0 * (service in r["impact"]) + 4.0 * (service in r["services"]) + 2.0 * (not r["services"].isdisjoint(reached))
            )
            if score > 0:
                score += max(0.0, 1.0 - (ts - r["last_ts"]) / gap)
                if score > best_score:
                    best, best_score = r, score
        if best is None:
            best = {"id": anomaly_id, "services": set(), "impact": set()}
            self.rows.append(best)
        best["last_ts"] = ts
        best["services"].add(service)
        best["impact"] |= reached
        return best["id"]

    def reopen(self, incident_id: str, last_ts: float, services: list[str], impact: list[str]) -> None:
        """Takes an incident over from an earlier run."""
        self.rows.append({"id": incident_id, "last_ts": last_ts, "services": set(services), "impact": set(impact)})


def assign_incidents(anomalies: DataFrame, p: Params, by: list[str] | None = None, opened: DataFrame | None = None) -> DataFrame:
    """Adds ``incident_id`` to each anomaly (which has blast_radius).

    An anomaly can only join an incident whose last signal is at most the gap old and
    that shares a service with what it reaches. So the work is split exactly: by
    pauses longer than the gap, then by groups of linked services, then by the pauses
    of each group. ``by`` names columns, such as a tenant, that never share incidents.

    ``opened`` are the incidents that an earlier run left open (``open_incidents``);
    the anomalies are then those after it, and nothing older is folded again.
    """
    by = by or []
    gap = p.correlation_gap_s
    fresh = anomalies.select(
        *by, F.lit(1).alias("turn"), *ORDER, "anomaly_id", "service", F.col("tick").alias("seen"), "blast_radius",
        F.lit(None).cast("string").alias("state"),
    )
    if opened is not None:
        fresh = fresh.unionByName(
            opened.select(
                *by, F.lit(0).alias("turn"), *[F.col(f"born.{c}").alias(c) for c in ORDER], F.col("incident_id").alias("anomaly_id"),
                F.col("services")[0].alias("service"), F.col("last_ts").alias("seen"), F.array_union("services", "impact").alias("blast_radius"),
                F.to_json(F.struct("last_ts", "services", "impact")).alias("state"),
            )
        )
    fresh = stage(fresh, "to_assign") if opened is not None else fresh
    chained = fresh.join(chain_by_gap(fresh.select(*by, "seen").distinct(), "seen", gap, "chain", by), [*by, "seen"])
    linked = chained.join(linked_services(chained, [*by, "chain"]), [*by, "chain", "service"]).withColumnRenamed("chain", "outer_chain")
    part = [*by, "outer_chain", "linked"]
    chained = linked.join(chain_by_gap(linked.select(*part, "seen").distinct(), "seen", gap, "chain", part), [*part, "seen"]).select(
        *part, "chain", "turn", *ORDER, "anomaly_id", "service", F.to_json("blast_radius").alias("blast"), "state"
    )
    at = chained.columns.index("tick")

    def step(state: OpenIncidents, row: tuple):
        anomaly_id, service, blast, saved = row[-4:]
        if saved is not None:
            state.reopen(anomaly_id, **json.loads(saved))
        else:
            yield anomaly_id, state.add(anomaly_id, row[at], service, json.loads(blast), gap)

    found = ordered_fold(
        chained, [*part, "chain"], ["turn", *ORDER, "anomaly_id"], OpenIncidents, step, "anomaly_id string, first_id string"
    )
    named = F.when(F.startswith("first_id", F.lit("inc_")), F.col("first_id")).otherwise(S.short_id("inc_", "first_id"))
    return anomalies.join(found, "anomaly_id").withColumn("incident_id", named).drop("first_id")


class Linked:
    """Disjoint sets of services; a set goes by its smallest member."""

    def __init__(self) -> None:
        self.above: dict[str, str] = {}

    def root(self, service: str) -> str:
        above = self.above.setdefault(service, service)
        while above != service:
            self.above[service] = self.above[above]
            service, above = above, self.above[above]
        return service

    def join(self, a: str, b: str) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.above[b] = a


def linked_services(anomalies: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, service, linked``: the smallest service that a service is linked to, where
    an anomaly links its own to all that it reaches. One pass over distinct pairs; a task
    holds the services of one chain, never its pairs or anomalies."""
    pairs = anomalies.select(*keys, "service", F.explode("blast_radius").alias("other")).distinct()
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def step(state: Linked, row: tuple):
        state.join(*row[-2:])
        return ()

    def finish(state: Linked, key: tuple):
        for service in state.above:
            yield *key, service, state.root(service)

    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "service"]) + ", linked string"
    return stage(ordered_fold(pairs, keys, [], Linked, step, schema, finish), "linked")


def open_incidents(members: DataFrame, p: Params, by: list[str] | None = None, opened: DataFrame | None = None) -> DataFrame:
    """Incidents that may still take an anomaly after the last of ``members``: what a run
    saves for the next one. ``opened`` is what it started from itself."""
    by = by or []
    now = members.agg(F.max("tick")).first()[0]
    rows = members.select(
        *by, "incident_id", F.col("tick").alias("last_ts"), F.array("service").alias("services"), F.col("blast_radius").alias("impact"),
        F.struct(*ORDER, "anomaly_id").alias("born"),
    )
    if opened is not None:
        rows = rows.unionByName(opened.select(*rows.columns))
    merged = rows.groupBy(*by, "incident_id").agg(
        F.max("last_ts").alias("last_ts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("services")))).alias("services"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("impact")))).alias("impact"),
        F.min("born").alias("born"),
    )
    return merged.filter(F.lit(now) - F.col("last_ts") <= p.correlation_gap_s)


def incident_impact(members: DataFrame) -> DataFrame:
    """Fewest hops at which each service is hit, per incident."""
    return (
        members.select("incident_id", F.explode("blast_hops").alias("service", "hops"))
        .groupBy("incident_id", "service")
        .agg(F.min("hops").alias("hops"))
    )


def root_ranking(
    members: DataFrame, tick_topology: DataFrame, reached: DataFrame, p: Params
) -> DataFrame:
    """Every member service of every incident, best root first.

    A member scores 100 per other member that reaches it, plus the mean hops
    from those; ties go by name. Reachability is that of the last tick with any
    anomaly while the incident is kept.
    """
    moments = _last_tick_kept(members, p)
    ended = members.groupBy("incident_id").agg(F.max("tick").alias("tick"))
    graph_of = (
        ended.join(moments, "tick").select("incident_id", "rank_tick_no")
        .join(tick_topology.withColumnRenamed("tick_no", "rank_tick_no"), "rank_tick_no", "left")
        .select("incident_id", "topology")
    )
    services = members.select("incident_id", "service").distinct()
    hits = (
        services.join(graph_of, "incident_id")
        .withColumnRenamed("service", "source")
        .join(reached, ["topology", "source"])
        .filter(F.col("source") != F.col("service"))
        .join(services, ["incident_id", "service"], "left_semi")
        .groupBy("incident_id", "service")
        .agg(F.count(F.lit(1)).alias("reached_by"), F.avg("hops").alias("mean_hops"))
    )
    order = Window.partitionBy("incident_id").orderBy(F.col("score").desc(), F.col("service"))
    return (
        services.join(hits, ["incident_id", "service"], "left")
        .select(
            "incident_id",
            "service",
            F.coalesce("reached_by", F.lit(0)).cast("bigint").alias("reached_by"),
            (F.coalesce("reached_by", F.lit(0)) * 100.0 + F.coalesce("mean_hops", F.lit(0.0))).alias("score"),
        )
        .withColumn("place", F.row_number().over(order))
    )


def _last_tick_kept(members: DataFrame, p: Params) -> DataFrame:
    """For each tick with anomalies the last such tick at most ``drop_s`` later."""
    ticks = members.select("tick", "tick_no").distinct()
    slice_s = p.drop_s
    sliced = ticks.withColumn("own", F.floor(F.col("tick") / slice_s)).withColumn(
        "slice", F.explode(F.array(F.col("own"), F.col("own") - 1))
    )
    ahead = Window.partitionBy("slice").orderBy("tick_no").rangeBetween(0, int(p.drop_s // p.tick_s))
    return (
        sliced.withColumn("rank_tick_no", F.max("tick_no").over(ahead))
        .filter(F.col("slice") == F.col("own"))
        .select("tick", "rank_tick_no")
    )


def state_at(last_ts, as_of: float, p: Params) -> Column:
    """active, resolving or resolved; null once an incident is dropped."""
    since = F.lit(as_of) - (F.col(last_ts) if isinstance(last_ts, str) else last_ts)
    return (
        F.when(since > p.drop_s, F.lit(None).cast("string"))
        .when(since > p.close_s, "resolved")
        .when(since > p.resolve_s, "resolving")
        .otherwise("active")
    )


def incident_records(
    members: DataFrame, tick_topology: DataFrame, reached: DataFrame, p: Params, keep: int = 50
) -> DataFrame:
    """One row per incident over its whole life."""
    place = F.struct(*ORDER, "anomaly_id")
    core = members.groupBy("incident_id").agg(
        F.min("tick").alias("started"),
        F.max("tick").alias("last_ts"),
        F.max("severity").alias("severity"),
        F.min_by("description", F.struct((-F.col("severity")).alias("s"), place.alias("place"))).alias("suspected_cause"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.count(F.lit(1)).alias("anomaly_count"),
    )
    near = F.array_sort(F.collect_list(F.struct("hops", "service")))
    impact = (
        incident_impact(members)
        .groupBy("incident_id")
        .agg(near.alias("near"))
        .select(
            "incident_id",
            F.col("near.service").alias("impact"),
            F.map_from_entries(F.transform("near", lambda x: F.struct(x["service"], x["hops"]))).alias("impact_hops"),
        )
    )
    newest = Window.partitionBy("incident_id").orderBy(*[F.col(c).desc() for c in [*ORDER, "anomaly_id"]])
    last = F.array_sort(F.collect_list(F.struct((-F.col("place")).alias("at"), "anomaly_id", "kind")))
    tail = (
        members.select("incident_id", *ORDER, "anomaly_id", "kind")
        .withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") <= keep)
        .groupBy("incident_id")
        .agg(last.alias("tail"))
        .select(
            "incident_id", F.col("tail.anomaly_id").alias("anomaly_ids"), F.col("tail.kind").alias("anomaly_kinds")
        )
    )
    tally = kind_tally(members)
    roots = root_ranking(members, tick_topology, reached, p).filter("place = 1").select(
        "incident_id", F.col("service").alias("root_service")
    )
    title = F.when(
        F.size("services") <= 1, F.concat(F.col("root_service"), F.lit(" · "), F.col("kinds_text"))
    ).otherwise(
        F.concat(F.col("root_service"), F.lit(" incident · "), F.size("services").cast("string"), F.lit(" services"))
    )
    return (
        core.join(impact, "incident_id")
        .join(tail, "incident_id")
        .join(tally, "incident_id")
        .join(roots, "incident_id")
        .withColumn("title", title)
        .drop("kinds_text")
    )


def kind_tally(members: DataFrame) -> DataFrame:
    """Anomalies per kind, in order of first appearance, as one text."""
    per_kind = members.groupBy("incident_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER, "anomaly_id")).alias("first")
    )
    parts = F.array_sort(F.collect_list(F.struct("first", "kind", "n")))
    return per_kind.groupBy("incident_id").agg(
        F.array_join(
            F.transform(
                parts, lambda x: F.concat(F.replace(x["kind"], F.lit("_"), F.lit(" ")), F.lit("×"), x["n"].cast("string"))
            ),
            ", ",
        ).alias("kinds_text")
    )


def incident_board(records: DataFrame, as_of: float, p: Params) -> DataFrame:
    """Kept incidents with their state, newest signal first."""
    return (
        records.withColumn("state", state_at("last_ts", as_of, p))
        .filter(F.col("state").isNotNull())
        .orderBy(F.col("last_ts").desc(), "incident_id")
    )


def active_incidents(board: DataFrame, limit: int = 20) -> DataFrame:
    """Unresolved incidents, most severe first."""
    return (
        board.filter("state <> 'resolved'")
        .orderBy(F.col("severity").desc(), F.col("last_ts").desc(), "incident_id")
        .limit(limit)
    )


def panel_order(board: DataFrame) -> DataFrame:
    """Active ones first, then by severity."""
    return board.orderBy((F.col("state") == "active").desc(), F.col("severity").desc(), "incident_id")


def focus_incident(board: DataFrame) -> DataFrame:
    """The unresolved incident to show first."""
    return active_incidents(board, 1)


def active_count(board: DataFrame) -> DataFrame:
    return board.filter("state <> 'resolved'").agg(F.count(F.lit(1)).alias("active_incidents"))
