"""Keyed state of the continuous detectors.

Each processor keeps a few numbers or a short list per key. A key's input may
arrive in several pandas chunks; all are gathered and put in order first. A
batch holds no more than what one trigger read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from signalgraph.operators.detect import ORDER
from signalgraph.operators.incidents import OpenIncidents
from signalgraph.operators.templates import LeafGroups
from signalgraph.params import Params
from signalgraph.functions.scalars import PLACEHOLDER


def _columns(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(", ")]


class Processor(StatefulProcessor):
    """One string of JSON per key; subclasses say how rows change it."""

    output: str
    order: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gathered = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        state = self.load(json.loads(self.kept.get()[0]) if self.kept.exists() else self.start())
        columns = _columns(self.output)
        out = [r for row in gathered.to_dict("records") for r in self.step(state, row)]
        self.kept.update((json.dumps(self.dump(state)),))
        if out:
            yield pd.DataFrame(out, columns=columns)

    def close(self) -> None:
        pass

    def start(self) -> dict:
        return {}

    def load(self, saved: dict):
        """What ``step`` works on during a batch; ``dump`` is the way back."""
        return saved

    def dump(self, state) -> dict:
        return state

    def step(self, state, row: dict):
        raise NotImplementedError


def run(df: DataFrame, keys: list[str], processor: Processor, in_time: bool = False) -> DataFrame:
    """``in_time``: by event time, so that operators that go by it can follow. Rows that come
    later than the watermark are left out then."""
    timed = {"timeMode": "EventTime", "eventTimeColumnName": "event_time"} if in_time else {"timeMode": "None"}
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", **timed
    )


class ServiceSignals(Processor):
    """Rolling z of total, errors and p95, and the error-rate forecast."""

    output = (
        "event_time timestamp, service string, tick_no long, tick double, total long, errors long, p95 double, error_rate double, "
        "z_total double, z_errors double, z_p95 double, forecast double, stddev double"
    )
    order = ["tick_no"]
    watched = ("total", "errors", "p95")

    def __init__(self, p: Params) -> None:
        self.p = p

    def start(self) -> dict:
        return {"samples": {c: [] for c in self.watched}, "mean": None, "variance": 0.0}

    def step(self, state: dict, row: dict):
        z = []
        for c in self.watched:
            seen = state["samples"][c] = [*state["samples"][c], float(row[c])][-self.p.z_samples :]
            mean = sum(seen) / len(seen)
            sd = math.sqrt(sum((x - mean) ** 2 for x in seen) / len(seen))
            z.append(0.0 if len(seen) < self.p.z_min_samples or sd < 1e-6 else (seen[-1] - mean) / sd)
        x, a = row["error_rate"], self.p.ewma_alpha
        if state["mean"] is None:
            state["mean"] = x
        else:
            off = x - state["mean"]
            state["variance"] = a * off * off + (1 - a) * state["variance"]
            state["mean"] = a * x + (1 - a) * state["mean"]
        yield (
            row["event_time"], row["service"], row["tick_no"], row["tick"], row["total"], row["errors"], row["p95"], row["error_rate"], *z,
            state["mean"], math.sqrt(state["variance"]),
        )


class EdgeDecay(Processor):
    """Weight of an edge at each tick that saw calls on it."""

    output = "source string, target string, tick_no long, weight double"
    order = ["tick_no"]

    def __init__(self, p: Params) -> None:
        self.p = p

    def start(self) -> dict:
        return {"weight": 0.0, "tick_no": None}

    def step(self, state: dict, row: dict):
        silent = 0 if state["tick_no"] is None else max(0, row["tick_no"] - state["tick_no"] - 1)
        weight = state["weight"]
        for _ in range(silent):
            weight *= self.p.edge_decay
            if weight < self.p.edge_floor:
                weight = 0.0
                break
        state["weight"] = weight * self.p.edge_decay + row["calls"]
        state["tick_no"] = row["tick_no"]
        yield row["source"], row["target"], row["tick_no"], state["weight"]


class Packed:
    """A map state of two-part keys (the second may be empty). Each call to a state takes a message to Spark
    and back, whatever it carries, so entries are kept one by one only while they are few. Once
    they are many they are kept in slots, told by the first part of the key, of which a batch reads and writes
    those that it needs; slots become more as entries do, so that each stays small."""

    FEW = 64  # entries kept one by one
    SLOT = 256  # entries a slot has when slots are laid out; twice as many lay them out anew

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str, value: str) -> None:
        self.width = len(_columns(key)) - 1
        self.single = handle.getMapState(name, key, value)
        self.slots = handle.getMapState(f"{name}_slots", "slot int", "body string")
        self.shape = handle.getValueState(f"{name}_shape", "slots int, n long")

    def open(self) -> "PackedBatch":
        """The entries of the key at hand, for as long as one batch of it."""
        return PackedBatch(self)


class PackedBatch:
    def __init__(self, kept: Packed) -> None:
        self.kept = kept
        self.slots, self.n = self.stored = tuple(kept.shape.get()) if kept.shape.exists() else (0, 0)
        self.held: dict[int, dict[str, dict[tuple, tuple]]] = {}
        self.changed: dict[int, set[tuple]] = {}  # of each slot: keys put or dropped
        if not self.slots:
            self.held[0] = {}
            for key, value in list(kept.single.iterator()) if self.n else ():
                self.held[0].setdefault(key[0], {})[tuple(key[1:])] = tuple(value)

    def _slot(self, first: str) -> int:
        slot = zlib.crc32(first.encode()) % self.slots if self.slots else 0
        if slot not in self.held:
            body = self.kept.slots.getValue((slot,))[0] if self.kept.slots.containsKey((slot,)) else None
            self.held[slot] = self._read(body)
        return slot

    def _read(self, body: str | None) -> dict[str, dict[tuple, tuple]]:
        width = self.kept.width
        return {first: {tuple(r[:width]): tuple(r[width:]) for r in rows} for first, rows in json.loads(body)} if body else {}

    def of(self, first: str) -> dict[tuple, tuple]:
        """Values by the second part of the key."""
        return self.held[self._slot(first)].get(first, {})

    def put(self, first: str, rest: tuple, value: tuple) -> None:
        slot = self._slot(first)
        entries = self.held[slot].setdefault(first, {})
        self.n += rest not in entries
        entries[rest] = value
        self.changed.setdefault(slot, set()).add((first, *rest))

    def drop(self, first: str, rest: tuple) -> None:
        slot = self._slot(first)
        entries = self.held[slot][first]
        del entries[rest]
        if not entries:
            del self.held[slot][first]
        self.n -= 1
        self.changed.setdefault(slot, set()).add((first, *rest))

    def all(self) -> Iterator[tuple[str, tuple, tuple]]:
        self._read_all()
        for slot in list(self.held.values()):
            for first, entries in list(slot.items()):
                for rest, value in list(entries.items()):
                    yield first, rest, value

    def _read_all(self) -> None:
        if len(self.held) < self.slots:
            for key, body in list(self.kept.slots.iterator()):
                if key[0] not in self.held:
                    self.held[key[0]] = self._read(body[0])
            for slot in range(self.slots):
                self.held.setdefault(slot, {})

    def save(self) -> None:
        if self.n > (2 * self.kept.SLOT * self.slots or self.kept.FEW):
            self._lay_out()
        elif self.slots:
            for slot in self.changed:
                self._write(slot)
        else:
            for key in self.changed.get(0, ()):
                value = self.of(key[0]).get(key[1:])
                if value is not None:
                    self.kept.single.updateValue(key, value)
                elif self.kept.single.containsKey(key):
                    self.kept.single.removeKey(key)
        if (self.slots, self.n) != self.stored:
            self.kept.shape.update((self.slots, self.n))

    def _lay_out(self) -> None:
        """Deals all entries to as many slots as they need now."""
        self._read_all()
        if not self.slots:
            for key in list(self.kept.single.iterator()) if self.stored[1] else ():
                self.kept.single.removeKey(key[0])
        before, self.slots = self.held, 1 << max(0, (self.n - 1) // self.kept.SLOT).bit_length()
        self.held = {slot: {} for slot in range(self.slots)}
        for slot in before.values():
            for first, entries in slot.items():
                self.held[self._slot(first)][first] = entries
        for slot in self.held:
            self._write(slot)

    def _write(self, slot: int) -> None:
        if self.held[slot]:
            rows = [[first, [[*rest, *value] for rest, value in entries.items()]] for first, entries in self.held[slot].items()]
            self.kept.slots.updateValue((slot,), (json.dumps(rows, ensure_ascii=False),))
        elif self.kept.slots.containsKey((slot,)):
            self.kept.slots.removeKey((slot,))


class Branch(StatefulProcessor):
    """Sends messages along their first tokens; a path takes only so many branches. A key is a
    bucket of widths, where paths start; a path's branches are an entry of a map."""

    output = "event_time timestamp, ts double, span_id string, service string, masked string, leaf string"

    def __init__(self, depth: int, most: int) -> None:
        self.depth, self.most = depth, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = Packed(handle, "branches", "leaf string", "words array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "span_id", "masked"], kind="stable")
        kept = self.kept.open()
        known: dict[str, dict[str, None]] = {}
        sizes: dict[str, int] = {}
        leaves = []
        for leaf, masked in zip(new["leaf"].tolist(), new["masked"].tolist()):
            for word in masked.split(" ", self.depth)[: self.depth]:
                if leaf not in known:
                    known[leaf] = dict.fromkeys(kept.of(leaf).get((), ((),))[0])
                    sizes[leaf] = len(known[leaf])
                if word.startswith("<"):
                    word = PLACEHOLDER
                if word not in known[leaf]:
                    if len(known[leaf]) < self.most:
                        known[leaf][word] = None
                    else:
                        word = PLACEHOLDER
                leaf = f"{leaf} {word}"
            leaves.append(leaf)
        for leaf, words in known.items():
            if len(words) > sizes[leaf]:
                kept.put(leaf, (), (list(words),))
        kept.save()
        yield new.assign(leaf=leaves)[_columns(self.output)]

    def close(self) -> None:
        pass


class Leaf(StatefulProcessor):
    """Joins a message to the most similar group of its leaf; a blank one to none. A key is a
    bucket of leaves; each group's text is an entry of a map."""

    output = "event_time timestamp, ts double, span_id string, service string, masked string, leaf string, grp long, is_new boolean"

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = Packed(handle, "texts", "leaf string, grp long", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "span_id", "masked"], kind="stable")
        kept = self.texts.open()
        held: dict[str, LeafGroups] = {}
        touched: dict[str, set[int]] = {}
        found = []
        for leaf, masked in zip(new["leaf"].tolist(), new["masked"].tolist()):
            if not masked:
                found.append((-1, False))
                continue
            if leaf not in held:
                held[leaf], touched[leaf] = LeafGroups(), set()
                for _, (text,) in sorted(kept.of(leaf).items()):
                    held[leaf].append(text.split(" "))
            grp, is_new = held[leaf].add(masked.split(" "), self.threshold)
            touched[leaf].add(grp)
            found.append((grp, is_new))
        for leaf, groups in held.items():
            texts = list(groups.texts())
            for grp in touched[leaf]:
                kept.put(leaf, (grp,), (texts[grp],))
        kept.save()
        yield new.assign(grp=[g for g, _ in found], is_new=[n for _, n in found])[_columns(self.output)]

    def close(self) -> None:
        pass


class IncidentFold(Processor):
    """Open incidents of one tenant."""

    output = "anomaly_id string, tick double, service string, first_id string"
    order = ORDER

    def __init__(self, p: Params) -> None:
        self.p = p

    def start(self) -> dict:
        return {"rows": []}

    def load(self, saved: dict) -> OpenIncidents:
        fold = OpenIncidents()
        fold.rows = [{**r, "services": set(r["services"]), "impact": set(r["impact"])} for r in saved["rows"]]
        return fold

    def dump(self, state: OpenIncidents) -> dict:
        return {"rows": [{**r, "services": sorted(r["services"]), "impact": sorted(r["impact"])} for r in state.rows]}

    def step(self, state: OpenIncidents, row: dict):
        blast = list(row["blast_radius"])
        first = state.add(row["anomaly_id"], row["tick"], row["service"], blast, self.p.correlation_gap_s)
        yield row["anomaly_id"], row["tick"], row["service"], first
