"""The whole detection chain over a log table, every tick at once.

Frames read by several steps are staged once. All attributes are lazy: a query
pays only for the steps it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgraph.operators import correlation as C
from signalgraph.operators import detect as D
from signalgraph.operators import forecast as E
from signalgraph.operators import graph as G
from signalgraph.operators import iforest as I
from signalgraph.operators import incidents as N
from signalgraph.operators import rates as R
from signalgraph.operators import rules as U
from signalgraph.operators import templates as T
from signalgraph.params import Params
from signalgraph.sources.logs import first_ts, last_ts
from signalgraph.sources.staging import stage


class Replay:
    def __init__(self, logs: DataFrame, params: Params, rules: DataFrame | None = None) -> None:
        self.raw_logs = logs
        self.p = params
        self.spark = logs.sparkSession
        self._rules = rules

    @cached_property
    def started(self) -> float:
        return first_ts(self.raw_logs)

    @cached_property
    def last_ts(self) -> float:
        return last_ts(self.raw_logs)

    @cached_property
    def last_tick_no(self) -> int:
        return R.last_tick_no(self.last_ts, self.p)

    @property
    def now(self) -> float:
        """End of the last tick: the moment of the detector's latest run."""
        return self.last_tick_no * self.p.tick_s

    @cached_property
    def rules(self) -> DataFrame:
        return U.rules_frame(self.spark) if self._rules is None else self._rules

    @cached_property
    def ticks(self) -> DataFrame:
        """Per-tick aggregates; the detectors need no other quantile than p95."""
        return stage(R.service_ticks(self.raw_logs, self.p, ("p95",), self.last_tick_no), "ticks")

    @cached_property
    def numbered(self) -> DataFrame:
        """Ticks that hold rows, with their running number ``seq``; from the
        small per-tick table where that is there already."""
        if "ticks" in self.__dict__:
            return stage(R.number_ticks(self.ticks, self.p), "tick_numbers")
        return stage(R.tick_numbers(self.raw_logs, self.p, self.last_tick_no), "tick_numbers")

    @cached_property
    def mined(self) -> tuple[DataFrame, DataFrame]:
        return T.mine_templates(self.raw_logs, self.p)

    @property
    def templates(self) -> DataFrame:
        return self.mined[0]

    @cached_property
    def logs(self) -> DataFrame:
        """The logs with their template ids."""
        return T.assign_templates(self.raw_logs, self.mined[1])

    @cached_property
    def edge_calls(self) -> DataFrame:
        return stage(G.edge_ticks(self.raw_logs, self.p, self.last_tick_no), "edge_calls")

    @cached_property
    def edge_weights(self) -> DataFrame:
        return stage(G.edge_weights(self.edge_calls, self.numbered, self.p), "edge_weights")

    @cached_property
    def node_metrics(self) -> DataFrame:
        return G.node_metrics(self.ticks, self.p)

    @cached_property
    def topologies(self) -> tuple[DataFrame, DataFrame]:
        per_tick, edges = G.topologies(self.edge_weights, self.p)
        return stage(per_tick, "tick_topology"), stage(edges, "topology_edges")

    @cached_property
    def blast(self) -> DataFrame:
        return G.blast_radius(G.reach(self.topologies[1], self.p.blast_depth))

    @cached_property
    def rule_firings(self) -> DataFrame:
        matches = U.rule_matches(self.ticks, self.rules, self.p)
        return U.rule_firings(U.rule_dwell(matches, self.numbered))

    @cached_property
    def forest(self) -> DataFrame:
        return I.forest_per_tick(R.feature_matrix(self.ticks), self.p)

    @cached_property
    def anomalies(self) -> DataFrame:
        found = D.all_anomalies(
            D.rate_anomalies(R.zscores(self.ticks, self.p), self.p),
            D.feature_anomalies(self.forest, self.ticks),
            D.template_anomalies(T.new_templates(self.templates, self.p, self.started)),
            D.rule_anomalies(self.rule_firings),
        )
        return stage(D.with_blast_radius(found, self.topologies[0], self.blast), "anomalies")

    @cached_property
    def members(self) -> DataFrame:
        """Anomalies with the incident each belongs to."""
        return stage(N.assign_incidents(self.anomalies, self.p), "members")

    @cached_property
    def root_reach(self) -> DataFrame:
        return G.reach(self.topologies[1], self.p.root_depth)

    @cached_property
    def incidents(self) -> DataFrame:
        return stage(N.incident_records(self.members, self.topologies[0], self.root_reach, self.p), "incidents")

    def board(self, as_of: float | None = None) -> DataFrame:
        """Incidents as they stood at ``as_of``: later signals are not known yet."""
        if as_of is None or as_of >= self.now:
            return N.incident_board(self.incidents, self.now if as_of is None else as_of, self.p)
        past = self.members.filter(F.col("tick") <= as_of)
        records = N.incident_records(past, self.topologies[0], self.root_reach, self.p)
        return N.incident_board(records, as_of, self.p)

    @cached_property
    def forecast(self) -> DataFrame:
        return E.forecast(self.ticks, self.p)

    def forecast_now(self) -> DataFrame:
        return E.forecast_now(self.ticks, self.p)

    def correlation(self, as_of: float | None = None) -> DataFrame:
        as_of = self.last_ts if as_of is None else as_of
        start, end = R.bucket_bounds(as_of, self.p)
        return C.correlation(R.problem_rates(self.raw_logs, self.p, as_of), start, end)
