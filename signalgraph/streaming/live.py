"""Detectors that share one clock in event time.

Rows of all kinds wait in state, per tenant, until the watermark passes the end of their
tick; a timer then folds the waiting ticks in order. So rules, the call graph and incidents
see ticks as the batch operators do: numbered by those that hold rows, calls and anomalies of
a tick together, silent ticks included. What has no rows to wake it (an edge that fades with
the ticks, an incident that resolves) is driven by the clock too: the former by the ticks of
others, the latter by timers of its own.

A key's state is bounded by what lives: rules, edges above the floor, incidents not yet
dropped, rows of ticks that have not closed. Input is small and derived (a row per service,
edge or anomaly and tick).
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalgraph.operators.correlation import FLAT
from signalgraph.operators.iforest import tick_decisions
from signalgraph.operators.incidents import OpenIncidents
from signalgraph.operators.rates import FEATURES
from signalgraph.params import Params
from signalgraph.streaming import state as ST

#: What a waiting row holds; a kind leaves the rest at their defaults.
ROW = {
    "tick_no": "long", "kind": "string", "service": "string", "target": "string", "calls": "double", "sub": "int",
    "severity": "double", "total": "long", "error_rate": "double", "p95": "double", "logs_per_min": "double",
    "at": "double", "rule_id": "string", "change": "string", "position": "int", "name": "string", "metric": "string",
    "op": "string", "threshold": "double", "duration_s": "double",
}
Row = namedtuple("Row", ROW)
BODY = ("position", "name", "service", "metric", "op", "threshold", "duration_s")


def live_rows(df: DataFrame, kind: str | Column, **columns: Column | str) -> DataFrame:
    """``df`` as waiting rows: ``env`` and ``event_time`` of ``df``, and the columns given."""
    given = {"kind": F.lit(kind) if isinstance(kind, str) else kind} | {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    blank = lambda t: F.lit("" if t == "string" else 0)
    filled = [F.coalesce(given.get(c, blank(t)).cast(t), blank(t).cast(t)).alias(c) for c, t in ROW.items()]
    return df.select("env", "event_time", *filled)


class Clock(StatefulProcessor):
    """Folds ticks in order. Parts say what is kept and what a tick gives."""

    output: str

    def __init__(self, p: Params) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {t}" for c, t in ROW.items()))
        self.seq = handle.getValueState("seq", "n long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Names the states of a part."""

    def load(self) -> None:
        """Reads them before a fold."""

    def save(self) -> None:
        """Writes back what a fold has changed."""

    def tick(self, tick_no: int, seq: int, rows: list[Row]) -> Iterator[tuple]:
        """What a tick with rows gives; it has the running number ``seq``."""
        return iter(())

    def extras(self, tick_no: int, rows: list[Row]) -> Iterator[tuple]:
        """What a tick's rows give whether or not it holds logs, before the tick itself."""
        return iter(())

    def before(self, tick_no: int) -> Iterator[tuple]:
        """What happens by itself up to a tick, that one included."""
        return iter(())

    def due(self) -> int | None:
        """The next tick at which something happens by itself."""
        return None

    def ms(self, tick_no: int) -> int:
        return round(tick_no * self.p.tick_s * 1000)

    def wake(self, tick_no: int | None) -> None:
        if tick_no is not None:
            self.handle.registerTimer(self.ms(tick_no))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # rates of no service only move the clock; a filter before this would reach below the watermark
        named = (frame[(frame["service"] != "") | (frame["kind"] == "change")] for frame in rows)
        new = [row for frame in named for row in zip(*[frame[c].tolist() for c in ROW])]
        if new:
            self.waiting.appendList(new)
            self.wake(min(row[0] for row in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [Row(*row) for row in self.waiting.get()] if self.waiting.exists() else []
        ripe = sorted((r for r in held if self.ms(r.tick_no) <= now), key=lambda r: r.tick_no)
        rest = [r for r in held if self.ms(r.tick_no) > now]
        self.load()
        seq = self.seq.get()[0] if self.seq.exists() else 0
        out: list[tuple] = []
        for tick_no, group in groupby(ripe, key=lambda r: r.tick_no):
            rows = list(group)
            out.extend(self.before(tick_no - 1))
            out.extend(self.extras(tick_no, rows))
            if any(r.kind == "rate" for r in rows):
                seq += 1
                out.extend(self.tick(tick_no, seq, rows))
        out.extend(self.before(math.floor(now / self.ms(1))))
        self.save()
        self.seq.update((seq,))
        if ripe:
            self.waiting.put(rest) if rest else self.waiting.clear()
        self.wake(min((r.tick_no for r in rest), default=None))
        self.wake(self.due())
        if out:
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in self.output.split(", ")])

    def close(self) -> None:
        pass


# --- parts ------------------------------------------------------------------------------


class Rules:
    """Rule versions and their dwell. A dwell goes on over consecutive ticks that hold rows."""

    def __init__(self, p: Params, rules: list[tuple]) -> None:
        self.p, self.first = p, rules

    def open(self, handle: StatefulProcessorHandle) -> None:
        body = "position int, name string, service string, metric string, op string, threshold double, duration_s double"
        self.kept = handle.getMapState("rules", "rule_id string", f"{body}, enabled boolean, entered_at double, seen long, firing boolean")
        self.counts = handle.getMapState("fired", "rule_id string, scope string", "n long")

    def load(self) -> None:
        keys = (*BODY, "enabled", "entered_at", "seen", "firing")
        self.rules = {k[0]: dict(zip(keys, v)) for k, v in self.kept.iterator()}
        self.fired = {tuple(k): v[0] for k, v in self.counts.iterator()}
        if not self.rules:
            for rule_id, position, name, service, metric, op, threshold, duration_s, enabled in self.first:
                self.rules[rule_id] = self._fresh((position, name, service, metric, op, threshold, duration_s), enabled)

    def save(self) -> None:
        for rule_id, r in self.rules.items():
            self.kept.updateValue((rule_id,), tuple(r.values()))
        for key, n in self.fired.items():
            self.counts.updateValue(key, (n,))

    @staticmethod
    def _fresh(body: tuple, enabled: bool) -> dict:
        return {**dict(zip(BODY, body)), "enabled": enabled, "entered_at": 0.0, "seen": -1, "firing": False}

    def change(self, rows: list[Row]) -> None:
        for r in sorted(rows, key=lambda r: (r.at, r.change)):
            if r.change == "add":
                self.rules[r.rule_id] = self._fresh(tuple(getattr(r, c) for c in BODY), True)
            elif r.rule_id in self.rules:
                held = self.rules[r.rule_id]
                held["enabled"] = r.change == "enable"
                if r.change != "enable":
                    held.update(entered_at=0.0, seen=-1, firing=False)

    def firings(self, tick_no: int, seq: int, rates: list[Row]) -> Iterator[dict]:
        """Of the services that match at a tick, the busiest speaks for the rule."""
        tick = tick_no * self.p.tick_s
        rates = sorted(rates, key=lambda r: (-r.total, r.service))
        for rule_id, rule in sorted(self.rules.items()):
            if not rule["enabled"]:
                continue
            asked = (r for r in rates if rule["service"] in ("*", r.service))
            hit = next((r for r in asked if self._holds(rule, self._value(rule, r))), None)
            if hit is None:
                continue
            if rule["seen"] != seq - 1:
                rule.update(entered_at=tick, firing=False)
            rule["seen"] = seq
            if not rule["firing"] and tick - rule["entered_at"] >= rule["duration_s"]:
                rule["firing"] = True
                n = self.fired[rule_id, rule["service"]] = self.fired.get((rule_id, rule["service"]), 0) + 1
                yield {
                    **{c: rule[c] for c in ("position", "name", "metric")}, "rule_id": rule_id, "scope": rule["service"], "service": hit.service,
                    "value": self._value(rule, hit), "fired_count": n, "severity": min(0.95, 0.55 + 0.05 * n),
                }

    @staticmethod
    def _value(rule: dict, r: Row) -> float:
        return {"error_rate": r.error_rate, "p95_latency": r.p95, "logs_per_min": r.logs_per_min}.get(rule["metric"], 0.0)

    @staticmethod
    def _holds(rule: dict, value: float) -> bool:
        limit = rule["threshold"]
        return {">": value > limit, "<": value < limit, ">=": value >= limit, "<=": value <= limit}.get(rule["op"], False)


class Graph:
    """Weights of the living edges, and what a service reaches along them."""

    def __init__(self, p: Params) -> None:
        self.p = p
        self._known: dict[frozenset, dict[str, dict[str, int]]] = {}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("edges", "source string, target string", "weight double")

    def load(self) -> None:
        self.weights = {tuple(k): v[0] for k, v in self.kept.iterator()}
        self._stored = set(self.weights)

    def save(self) -> None:
        for edge in self._stored - set(self.weights):
            self.kept.removeKey(edge)
        for edge, weight in self.weights.items():
            self.kept.updateValue(edge, (weight,))

    def turn(self, calls: list[Row]) -> None:
        """One tick further: all edges decay, those with calls gain them, faint ones go."""
        seen = {(r.service, r.target): r.calls for r in calls}
        for edge in set(self.weights) | set(seen):
            weight = self.weights.get(edge, 0.0) * self.p.edge_decay + seen.get(edge, 0.0)
            if weight < self.p.edge_floor:
                self.weights.pop(edge, None)
            else:
                self.weights[edge] = weight

    def blasts(self) -> dict[str, dict[str, int]]:
        """Fewest hops from every caller to what it reaches; worked out once per set of edges."""
        alive = frozenset(e for e, w in self.weights.items() if w >= self.p.blast_edge_floor)
        if alive not in self._known:
            after: dict[str, list[str]] = {}
            for source, target in sorted(alive):
                after.setdefault(source, []).append(target)
            self._known = {alive: {s: self._reach(after, s) for s in after}}  # the last one only
        return self._known[alive]

    def _reach(self, after: dict[str, list[str]], source: str) -> dict[str, int]:
        hops, front = {source: 0}, [source]
        for hop in range(1, self.p.blast_depth + 1):
            front = list(dict.fromkeys(t for s in front for t in after.get(s, ()) if t not in hops))
            hops.update(dict.fromkeys(front, hop))
        return hops

    def blast(self, service: str) -> list[str]:
        hops = self.blasts().get(service, {service: 0})
        return sorted(hops, key=lambda s: (hops[s], s))


class Incidents:
    """Open incidents and the state each is in, until they are dropped."""

    PHASES = ("active", "resolving", "resolved", "dropped")
    # an incident is named by its first anomaly's place among all
    NAME = ("tick_no", "detector_ord", "ord_1", "ord_2", "ord_3")

    def __init__(self, p: Params) -> None:
        self.p = p

    def open(self, handle: StatefulProcessorHandle) -> None:
        name = "tick_no long, detector_ord int, ord_1 double, ord_2 string, ord_3 int"
        self.kept = handle.getMapState("incidents", name, "service string, last_no long, phase int, services array<string>, impact array<string>")

    def load(self) -> None:
        self.held = {}
        self.fold = OpenIncidents()
        for k, (service, last_no, phase, services, impact) in sorted((tuple(k), v) for k, v in self.kept.iterator()):
            self.held[k] = {"service": service, "last_no": last_no, "phase": phase}
            self.fold.reopen(k, last_no * self.p.tick_s, list(services), list(impact))
        self._stored = set(self.held)

    def save(self) -> None:
        for k in self._stored - set(self.held):
            self.kept.removeKey(k)
        for k, h in self.held.items():
            self.kept.updateValue(k, (h["service"], h["last_no"], h["phase"], sorted(h["row"]["services"]), sorted(h["row"]["impact"])))

    def _attach(self) -> None:
        """Incidents that can take no more signals leave the fold, not the board."""
        for r in self.fold.rows:
            self.held[r["id"]]["row"] = r

    def _due(self, h: dict) -> int:
        """The first tick by which the incident has been silent for longer than its phase allows."""
        after = (self.p.resolve_s, self.p.close_s, self.p.drop_s)[h["phase"]]
        return math.floor(h["last_no"] + after / self.p.tick_s) + 1

    def next_due(self) -> int | None:
        return min(map(self._due, self.held.values()), default=None)

    def turn(self, upto: int) -> Iterator[tuple[int, tuple, str]]:
        """Changes of state up to a tick: (tick_no, incident, state), in order."""
        self._attach()
        found = []
        for k, h in list(self.held.items()):
            while self._due(h) <= upto:
                at = self._due(h)
                h["phase"] += 1
                found.append((at, k, self.PHASES[h["phase"]]))
                if h["phase"] == 3:
                    del self.held[k]
                    break
        self.fold.rows = [r for r in self.fold.rows if r["id"] in self.held and self.held[r["id"]]["phase"] < 2]
        yield from sorted(found)

    def add(self, place: tuple, service: str, blast: list[str]) -> tuple[tuple, bool]:
        """The incident an anomaly joins or opens, and whether it turns active."""
        name = self.fold.add(place, place[0] * self.p.tick_s, service, blast, self.p.correlation_gap_s)
        h = self.held.setdefault(name, {"service": service, "phase": 3})
        turned = h["phase"] > 0
        h.update(last_no=place[0], phase=0)
        self._attach()
        return name, turned


# --- processors ---------------------------------------------------------------------------


class RuleClock(Clock):
    """Firings of rules that may change while the stream runs."""

    output = (
        "rule_id string, scope string, position int, name string, metric string, tick_no long, tick double, "
        "service string, value double, fired_count long, severity double"
    )

    def __init__(self, p: Params, rules: list[tuple] = ()) -> None:
        super().__init__(p)
        self.rules = Rules(p, list(rules))

    def open(self, handle):
        self.rules.open(handle)

    def load(self):
        self.rules.load()

    def save(self):
        self.rules.save()

    def extras(self, tick_no, rows):
        self.rules.change([r for r in rows if r.kind == "change"])
        return iter(())

    def tick(self, tick_no, seq, rows):
        for f in self.rules.firings(tick_no, seq, [r for r in rows if r.kind == "rate"]):
            tick = tick_no * self.p.tick_s
            yield (
                f["rule_id"], f["scope"], f["position"], f["name"], f["metric"], tick_no, tick, f["service"], f["value"], f["fired_count"], f["severity"],
            )


class GraphClock(Clock):
    """Every living edge at every tick that holds rows, those without calls too."""

    output = "tick_no long, tick double, source string, target string, weight double"

    def __init__(self, p: Params) -> None:
        super().__init__(p)
        self.graph = Graph(p)

    def open(self, handle):
        self.graph.open(handle)

    def load(self):
        self.graph.load()

    def save(self):
        self.graph.save()

    def tick(self, tick_no, seq, rows):
        self.graph.turn([r for r in rows if r.kind == "edge"])
        yield from self.told(tick_no)

    def told(self, tick_no: int) -> Iterator[tuple]:
        for (source, target), weight in sorted(self.graph.weights.items()):
            yield tick_no, tick_no * self.p.tick_s, source, target, weight


class BlastClock(GraphClock):
    """What each calling service reaches, at every tick that holds rows."""

    output = "tick_no long, source string, service string, hops long"

    def told(self, tick_no):
        for source, hops in self.graph.blasts().items():
            for service, n in hops.items():
                yield tick_no, source, service, n


class CorrelationClock(Clock):
    """Correlation of the services' problem rates every ``correlation_s``, over the buckets
    that end by then. Its ticks are buckets: state is a rate per service and bucket of the
    window, the pairs are worked out from it, so nothing drifts. Moments go on by timers until
    the window holds no bucket with rows."""

    output = "moment double, service_a string, service_b string, corr double"

    def open(self, handle):
        self.kept = handle.getListState("buckets", "bucket long, service string, rate double")
        self.told = handle.getValueState("told", "moment long")

    def load(self):
        self.held = [tuple(r) for r in self.kept.get()] if self.kept.exists() else []
        self.last = self.told.get()[0] if self.told.exists() else None

    def save(self):
        if self.held:
            self.kept.put(self.held)
            self.told.update((self.last,))
        elif self.kept.exists():
            self.kept.clear()
            self.told.clear()

    def ms(self, tick_no: int) -> int:
        return round(tick_no * self.p.bucket_s * 1000)

    def moment_at(self, end: int) -> int:
        """The last moment (its number) by the end of a bucket."""
        return math.floor(end * self.p.bucket_s / self.p.correlation_s + 1e-9)

    def tick(self, tick_no, seq, rows):
        if not self.held:
            self.last = self.moment_at(tick_no - 1)
        self.held.extend((tick_no - 1, r.service, r.error_rate) for r in rows)
        return iter(())

    def before(self, tick_no):
        while self.held and self.last < self.moment_at(tick_no):
            self.last += 1
            at = self.last * self.p.correlation_s
            end = math.floor(at / self.p.bucket_s + 1e-9)
            self.held = [r for r in self.held if r[0] >= end - self.p.buckets]
            yield from self.matrix(at, [r for r in self.held if r[0] < end], end)

    def due(self):
        return math.ceil((self.last + 1) * self.p.correlation_s / self.p.bucket_s - 1e-9) if self.held else None

    def matrix(self, at: float, rows: list[tuple], end: int) -> Iterator[tuple]:
        services = sorted({service for _, service, _ in rows})
        place = {service: i for i, service in enumerate(services)}
        x = np.zeros((len(services), self.p.buckets))
        for bucket, service, rate in rows:
            x[place[service], bucket - (end - self.p.buckets)] = rate
        x -= x.mean(1, keepdims=True)
        sd = np.sqrt((x * x).mean(1))
        moves = (sd >= FLAT) & (self.p.buckets >= 3)
        unit = np.where(moves[:, None], x / np.where(moves, sd, 1.0)[:, None], 0.0)
        corr = np.clip(unit @ unit.T / self.p.buckets, -1.0, 1.0)
        np.fill_diagonal(corr, 1.0)
        for i, a in enumerate(services):
            for j, b in enumerate(services):
                yield at, a, b, float(corr[i, j])


class IncidentClock(Clock):
    """Members of incidents, and every change of an incident's state."""

    output = (
        "event string, tick_no long, tick double, kind string, service string, severity double, ord_1 double, ord_2 string, ord_3 int, "
        "first_tick_no long, first_kind string, first_service string, first_1 double, first_2 string, first_3 int, reached array<string>"
    )
    KINDS = {0: "rate_spike", 3: "rule_fired"}

    def __init__(self, p: Params, rules: list[tuple] = ()) -> None:
        super().__init__(p)
        self.parts = self.rules, self.graph, self.incidents = Rules(p, list(rules)), Graph(p), Incidents(p)

    def open(self, handle):
        for part in self.parts:
            part.open(handle)

    def load(self):
        for part in self.parts:
            part.load()

    def save(self):
        for part in self.parts:
            part.save()

    def due(self):
        return self.incidents.next_due()

    def before(self, tick_no):
        services = {k: h["service"] for k, h in self.incidents.held.items()}
        for at, name, state in self.incidents.turn(tick_no):
            yield state, at, at * self.p.tick_s, "", "", 0.0, 0.0, "", 0, *self._named(name, services[name]), []

    def _named(self, name: tuple, service: str) -> tuple:
        return name[0], self.KINDS[name[1]], service, *name[2:]

    def extras(self, tick_no, rows):
        self.rules.change([r for r in rows if r.kind == "change"])
        return iter(())

    def tick(self, tick_no, seq, rows):
        rates = [r for r in rows if r.kind == "rate"]
        self.graph.turn([r for r in rows if r.kind == "edge"])
        found = [((tick_no, 0, -float(r.total), r.service, r.sub), r.service, r.severity) for r in rows if r.kind == "anomaly"]
        for f in self.rules.firings(tick_no, seq, rates):
            found.append(((tick_no, 3, float(f["position"]), f"{f['rule_id']}|{f['scope']}", 0), f["service"], f["severity"]))
        tick = tick_no * self.p.tick_s
        for place, service, severity in sorted(found):
            blast = self.graph.blast(service)
            name, turned = self.incidents.add(place, service, blast)
            first = self._named(name, self.incidents.held[name]["service"])
            row = (tick_no, tick, self.KINDS[place[1]], service, severity, *place[2:], *first, blast)
            yield "member", *row
            if turned:
                yield "active", *row


# New templates are numbered in order of their first messages. A micro-batch holds all rows of the
# ticks it closes: each slice of ticks orders its own, one key adds up a number per slice, and each
# slice takes its start from there. The rows themselves never meet in one task.


class SliceOrder(StatefulProcessor):
    """Places of a slice's new templates among its own, and a row that tells how many there are."""

    output = "event_time timestamp, slice long, is_count boolean, tick_no long, ts double, place long, service string, masked string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["tick_no", "ts", "span_id", "masked"], kind="stable")
        columns = [c.strip().split(" ")[0] for c in self.output.split(", ")]
        found = new.assign(is_count=False, place=new["is_new"].cumsum())[new["is_new"]]
        if len(found):
            yield found[columns]
        count = new.iloc[:1].assign(event_time=new["event_time"].max(), is_count=True, ts=new["ts"].min(), place=len(found))
        yield count[columns]

    def close(self) -> None:
        pass


class SliceStart(StatefulProcessor):
    """What was numbered before each slice, and when messages began, in place of a slice's count; rows go
    past it, under keys of their own."""

    output = SliceOrder.output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("templates", "n long, started double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ")[0] for c in self.output.split(", ")]
        if not key[0]:
            yield from (frame[columns] for frame in rows)
            return
        counts = pd.concat(list(rows), ignore_index=True).sort_values("slice", kind="stable")
        n, started = self.kept.get() if self.kept.exists() else (0, math.inf)
        started = min(started, float(counts["ts"].min()))
        upto = n + counts["place"].cumsum()
        self.kept.update((int(upto.iloc[-1]), started))
        yield counts.assign(ts=started, place=upto - counts["place"])[columns]

    def close(self) -> None:
        pass


class SliceNumbers(StatefulProcessor):
    """New templates of a slice with their numbers; those after the warm-up are told."""

    output = "tick_no long, tick double, template_id long, service string, first_text string"

    def __init__(self, p: Params) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        start = new[new["is_count"]].iloc[0]
        found = new[~new["is_count"]]
        tick = found["tick_no"] * self.p.tick_s
        out = found.assign(tick=tick, template_id=start["place"] + found["place"]).rename(columns={"masked": "first_text"})
        out = out[tick - start["ts"] >= self.p.warmup_s]
        if len(out):
            yield out[[c.strip().split(" ")[0] for c in self.output.split(", ")]]

    def close(self) -> None:
        pass


class FirstSights(StatefulProcessor):
    """Of the messages of a bucket those not seen before, or not for ``forget_s``. Their
    order is that of the panes they come in."""

    output = "event_time timestamp, ts double, span_id string, service string, masked string"

    def __init__(self, forget_s: float) -> None:
        self.forget_ms = round(forget_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = ST.Packed(handle, "seen", "masked string", "last_ms long")
        self.sweep = handle.getValueState("sweep", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "span_id"], kind="stable")
        last = (new.groupby("masked")["ts"].max() * 1000).astype("int64")
        seen = self.seen.open()
        fresh = []
        for masked, at in last.items():
            if not seen.of(masked):
                fresh.append(masked)
            seen.put(masked, (), (int(at),))
        seen.save()
        if not self.sweep.exists():
            self._next(max(timerValues.getCurrentWatermarkInMs(), int(last.max())))
        out = new[new["masked"].isin(fresh)].drop_duplicates("masked")
        if len(out):
            yield out[[c.strip().split(" ")[0] for c in self.output.split(", ")]]

    def _next(self, now: int) -> None:
        self.sweep.update((now + self.forget_ms,))
        self.handle.registerTimer(now + self.forget_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A message that comes again later is known to its leaf all the same."""
        now = timerValues.getCurrentWatermarkInMs()
        seen = self.seen.open()
        old = [masked for masked, _, (last,) in seen.all() if last <= now - self.forget_ms]
        for masked in old:
            seen.drop(masked, ())
        seen.save()
        if seen.n:
            self._next(now)
        else:
            self.sweep.clear()
        return iter(())

    def close(self) -> None:
        pass


class WindowRates(StatefulProcessor):
    """Counts, mean and exact p95 of a service's sliding windows, told as the watermark passes
    their ends. State is the panes of the windows that are still open."""

    output = (
        "event_time timestamp, tick_no long, tick double, service string, total long, errors long, warns long, mean_lat double, p95 double"
    )

    def __init__(self, p: Params) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane long", "total long, errors long, warns long, latencies binary")
        self.told = handle.getValueState("told", "tick_no long")

    def ms(self, tick_no: int) -> int:
        return round(tick_no * self.p.tick_s * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for pane, total, errors, warns, values in zip(*[frame[c].tolist() for c in ("pane", "total", "errors", "warns", "values")]):
                self.panes.updateValue((pane,), (total, errors, warns, np.asarray(values, np.float64).tobytes()))
                first = pane if first is None else min(first, pane)
        if first is not None:
            self.handle.registerTimer(self.ms(first + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        span, now = self.p.ticks_per_window, timerValues.getCurrentWatermarkInMs()
        told = self.told.get()[0] if self.told.exists() else None
        held = {k[0]: (*v[:3], np.frombuffer(v[3], np.float64)) for k, v in self.panes.iterator()}
        due = sorted({t for pane in held for t in range(pane + 1, pane + 1 + span) if self.ms(t) <= now and (told is None or t > told)})
        out = [self._rates(t, key[0], [held[pane] for pane in range(t - span, t) if pane in held]) for t in due]
        last = math.floor(now / self.ms(1))
        open_panes = [pane for pane in held if pane + span > last]
        for pane in held.keys() - set(open_panes):
            self.panes.removeKey((pane,))
        if open_panes:
            self.told.update((last,))
            self.handle.registerTimer(self.ms(max(last, min(open_panes)) + 1))
        elif self.told.exists():
            self.told.clear()
        if out:
            frame = pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in self.output.split(", ")])
            yield frame.assign(event_time=pd.to_datetime(frame["event_time"], unit="us", utc=True))

    def _rates(self, tick_no: int, service: str | None, panes: list[tuple]) -> tuple:
        total, errors, warns = (sum(p[i] for p in panes) for i in range(3))
        values = np.concatenate([p[3] for p in panes])
        mean = p95 = None
        if len(values):
            mean = float(values.sum()) / total
            at = (len(values) - 1) * 0.95
            low, high = math.floor(at), math.ceil(at)
            values.partition(sorted({low, high}))
            a, b = float(values[low]), float(values[high])
            p95 = a if a == b else (high - at) * a + (at - low) * b
        end_us = round(tick_no * self.p.tick_s * 1000000)
        return end_us - 1, tick_no, end_us / 1000000.0, service, total, errors, warns, mean, p95

    def close(self) -> None:
        pass


class TickForest(StatefulProcessor):
    """Grows a forest over the services of a tick once the tick has closed, and forgets it."""

    output = "tick_no long, tick double, service string, decision double, is_outlier boolean"

    def __init__(self, p: Params) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{c} double" for c in FEATURES)
        self.rows = handle.getListState("rows", f"tick double, service string, {columns}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            named = frame[frame["service"].notna()][["tick", "service", *FEATURES]]
            self.rows.appendList(list(named.itertuples(index=False, name=None)))
        self.handle.registerTimer(round(key[1] * self.p.tick_s * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=["tick", "service", *FEATURES])
        self.rows.clear()
        yield tick_decisions(held.assign(tick_no=key[1]), self.p)

    def close(self) -> None:
        pass


def run(rows: DataFrame, clock: Clock) -> DataFrame:
    """``rows`` are ``live_rows``; the rows' tenants are kept apart."""
    return timed_run(rows, ["env"], clock)


def timed_run(rows: DataFrame, keys: list[str], processor: StatefulProcessor) -> DataFrame:
    """Processors that hand on ``event_time`` can be followed by others that go by it."""
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="event_time" if "event_time" in processor.output else "",
    )
