"""The live clock: part by part over a stand-in for the state store, then over streams of
several micro-batches against the batch operators."""

import json
import random
from functools import cached_property

import pandas as pd
import pytest
from pyspark.sql import functions as F

import replicas
from test_streaming import close, story, stream  # noqa: F401
from signalgraph import Params
from signalgraph.operators import detect as D
from signalgraph.operators import graph as G
from signalgraph.operators import iforest as I
from signalgraph.operators import incidents as N
from signalgraph.operators import rates as R
from signalgraph.operators import reads
from signalgraph.operators import rules as U
from signalgraph.operators import templates as M
from signalgraph.plans import views as V
from signalgraph.plans.replay import Replay
from signalgraph.sources import logs as L
from signalgraph.sources.staging import stage
from signalgraph.streaming import jobs as J
from signalgraph.streaming import live as LV
from signalgraph.streaming import state as ST

P = Params()


class Store:
    """States and timers of one key, in memory."""

    def __init__(self):
        self.states, self.timers, self.watermark = {}, set(), 0

    def __getattr__(self, name):
        kinds = {"getValueState": Value, "getListState": List, "getMapState": Map}
        if name not in kinds:
            raise AttributeError(name)
        return lambda state, *schemas: self.states.setdefault(state, kinds[name]())

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = tuple(value)

    def clear(self):
        self.held = None


class List(Value):
    def get(self):
        return iter(self.held)

    def appendList(self, rows):
        self.held = [*(self.held or []), *rows]

    def put(self, rows):
        self.held = list(rows)


class Map:
    def __init__(self):
        self.held = {}

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[tuple(key)] = value

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))


def drain(make, batches, store=None):
    """Rows that a processor gives for micro-batches of (rows, watermark in s); a new
    processor for each batch, as after a restart."""
    store = store or Store()
    out = []
    for rows, watermark in batches:
        clock = make()
        clock.init(store)
        if rows:
            frame = pd.DataFrame([{**{c: "" if t == "string" else 0 for c, t in LV.ROW.items()}, **r} for r in rows])
            for frame in (frame.iloc[:1], frame.iloc[1:]):  # a key's rows come in chunks
                if len(frame):
                    out += [tuple(x) for f in clock.handleInputRows(("all",), iter([frame]), store) for x in f.itertuples(index=False)]
        store.watermark = round(watermark * 1000)
        while due := sorted(t for t in store.timers if t <= store.watermark):
            store.timers.discard(due[0])
            out += [tuple(x) for f in clock.handleExpiredTimer(("all",), store, None) for x in f.itertuples(index=False)]
    return out, store


def rate(tick_no, service, total=1, **kw):
    return {"tick_no": tick_no, "kind": "rate", "service": service, "total": total, **kw}


def edge(tick_no, source, target, calls):
    return {"tick_no": tick_no, "kind": "edge", "service": source, "target": target, "calls": float(calls)}


def spike(tick_no, service, severity=0.7):
    return {"tick_no": tick_no, "kind": "anomaly", "service": service, "severity": severity, "total": 1}


def test_edges_fade_at_ticks_without_calls():
    rows = [rate(t, "a") for t in range(1, 41)] + [edge(1, "a", "b", 3), edge(34, "a", "b", 1)]
    got, store = drain(lambda: LV.GraphClock(P), [(rows, 80)])
    weights = {r[0]: r[4] for r in got}
    assert weights[1] == 3 and weights[3] == pytest.approx(2.5392) and weights[28] == pytest.approx(0.3157858)
    assert not {29, 30, 33} & set(weights) and weights[34] == 1.0
    # below the floor nothing is kept
    _, store = drain(lambda: LV.GraphClock(P), [([rate(t, "a") for t in range(41, 60)], 200)], store)
    assert store.states["edges"].held == {}
    # ticks without rows are no ticks
    got, _ = drain(lambda: LV.GraphClock(P), [([rate(1, "a"), edge(1, "a", "b", 3), rate(9, "a")], 80)])
    assert [(r[0], round(r[4], 6)) for r in got] == [(1, 3.0), (9, 2.76)]


def test_batches_and_restarts_change_nothing():
    rng = random.Random(3)
    rows = []
    for t in range(1, 120):
        if rng.random() < 0.8:
            rows += [rate(t, s, rng.randrange(1, 9), error_rate=rng.random()) for s in "abcd"]
            rows += [edge(t, *rng.choice(["ab", "bc", "cd", "da"]), rng.randrange(1, 4)) for _ in range(1)]
            rows += [spike(t, rng.choice("abcd")) for _ in range(rng.randrange(2))]
    rules = [("r", 1, "errors", "*", "error_rate", ">", 0.9, 4.0, True), ("q", 2, "load", "a", "no such", "<", 1.0, 0.0, True)]
    make = lambda: LV.IncidentClock(P, rules)
    whole, _ = drain(make, [(rows, 10_000)])
    for step in (1, 7, 40):
        parts = [([r for r in rows if a <= r["tick_no"] < a + step], (a + step - 1) * P.tick_s) for a in range(1, 120, step)]
        split, _ = drain(make, [*parts, ([], 10_000)])
        assert sorted(map(str, split)) == sorted(map(str, whole))
    # rows that come ahead of the watermark wait for it
    early, _ = drain(make, [(rows, 0), ([], 100), ([], 10_000)])
    assert sorted(map(str, early)) == sorted(map(str, whole))
    assert {r[0] for r in whole} >= {"member", "active", "resolving", "resolved", "dropped"}


def test_states_of_an_incident():
    """Silent for more than 18 s: resolving; 45 s: resolved; 345 s: dropped and forgotten."""
    rows = [rate(10, "a"), spike(10, "a"), rate(22, "a"), spike(22, "a")]  # at 20 s and, still in time, at 44 s
    make = lambda: LV.IncidentClock(P)
    got, store = drain(make, [(rows, 50)])
    assert [(r[0], r[2]) for r in got] == [("member", 20.0), ("active", 20.0), ("resolving", 40.0), ("member", 44.0), ("active", 44.0)]
    got, store = drain(make, [([], 61.9), ([], 64), ([], 89.9), ([], 92)], store)
    assert [(r[0], r[2]) for r in got] == [("resolving", 64.0), ("resolved", 90.0)]
    assert len(store.states["incidents"].held) == 1
    got, store = drain(make, [([], 389.9), ([], 390)], store)
    assert [(r[0], r[2]) for r in got] == [("dropped", 390.0)]
    assert store.states["incidents"].held == {} and store.states["waiting"].held is None and not store.timers


def test_a_later_signal_opens_another_incident():
    rows = [rate(t, "a") for t in (10, 23)] + [spike(10, "a"), spike(23, "a")]  # 26 s apart
    got, _ = drain(lambda: LV.IncidentClock(P), [(rows, 46)])
    assert [(r[0], r[1], r[9]) for r in got if r[0] == "member"] == [("member", 10, 10), ("member", 23, 23)]


def test_signals_meet_through_the_graph():
    rows = [rate(1, "a"), edge(1, "a", "b", 1), spike(1, "a"), rate(2, "a"), spike(2, "b"), rate(3, "a"), spike(3, "z")]
    got, _ = drain(lambda: LV.IncidentClock(P), [(rows, 10)])
    assert [(r[4], r[9], list(r[15])) for r in got if r[0] == "member"] == [("a", 1, ["a", "b"]), ("b", 1, ["b"]), ("z", 3, ["z"])]


def test_members_are_those_of_a_plain_loop():
    rng = random.Random(5)
    near = {"a": ["a", "b"], "b": ["b"], "x": ["x", "y"], "y": ["y"]}
    rows, plain, t = [], [], 1
    for n in range(150):
        t += rng.choice([1, 1, 5, 12, 13])
        s = rng.choice(list(near))
        rows += [rate(t, "a"), edge(t, "a", "b", 1), edge(t, "x", "y", 1), spike(t, s)]
        plain.append((str(t), t * P.tick_s, s, near[s]))
    got, _ = drain(lambda: LV.IncidentClock(P), [(rows, 10_000)])
    assert {str(r[1]): str(r[9]) for r in got if r[0] == "member"} == replicas.incidents(plain, P.correlation_gap_s)


def test_rules_change_while_a_stream_runs():
    body = {"position": 1, "name": "n", "service": "*", "metric": "error_rate", "op": ">", "threshold": 0.5, "duration_s": 4.0}

    def change(tick_no, what, **kw):
        return {"tick_no": tick_no, "kind": "change", "at": tick_no * P.tick_s, "rule_id": "r", "change": what, **kw}

    high = [rate(t, "a", error_rate=0.9) for t in range(1, 31) if t not in (4, 5)]  # two ticks without any row
    rows = [*high, change(2, "add", **body), change(10, "disable"), change(15, "enable"), change(25, "delete"), change(26, "enable") | {"rule_id": "none"}]
    got, _ = drain(lambda: LV.RuleClock(P), [(rows, 100)])
    # from 4 s on; the empty ticks don't break it; anew after the switch
    assert [(r[5], r[9]) for r in got] == [(6, 1), (17, 2)]
    still, _ = drain(lambda: LV.RuleClock(P), [([*high, change(2, "add", **{**body, "op": "?"})], 100)])
    assert still == []


def test_messages_are_forgotten_after_silence():
    store = Store()
    sights = LV.FirstSights(100.0)
    sights.init(store)
    frame = lambda *rows: pd.DataFrame([{"event_time": pd.Timestamp(t, unit="s"), "ts": float(t), "span_id": "s", "service": "a", "masked": m} for t, m in rows])

    def sees(*rows):
        return [m for f in sights.handleInputRows((0,), iter([frame(*rows)]), store) for m in f["masked"]]

    assert sees((3, "x"), (1, "x"), (2, "y")) == ["x", "y"]
    assert sees((50, "x"), (60, "z")) == ["z"]
    store.watermark = 110_000
    list(sights.handleExpiredTimer((0,), store, None))
    assert set(store.states["seen"].held) == {("x",), ("z",)}
    assert sees((111, "y")) == ["y"] and sees((112, "x")) == []
    store.watermark = 900_000
    list(sights.handleExpiredTimer((0,), store, None))
    assert store.states["seen"].held == {} and store.states["sweep"].held is None


def test_leaves_survive_restarts():
    store = Store()
    groups = []
    for batch in (["a b c d x y", "a b c d z y"], ["a b c d q w", "k b c d q w", ""]):
        leaf = ST.Leaf(0.55)
        leaf.init(store)
        frame = pd.DataFrame([{"event_time": None, "ts": float(i), "span_id": "", "service": "s", "masked": m, "leaf": "6 " + m[:1]} for i, m in enumerate(batch)])
        groups += [x for f in leaf.handleInputRows((0,), iter([frame]), store) for x in zip(f["masked"], f["grp"], f["is_new"])]
    assert sorted(groups) == sorted([("a b c d x y", 0, True), ("a b c d z y", 0, False), ("a b c d q w", 0, False), ("k b c d q w", 0, True), ("", -1, False)])
    assert store.states["texts"].held[("6 a", 0)] == ("a b c d <*> <*>",)


class Counted(Store):
    """Counts the calls to its map states."""

    calls = 0

    def __getattr__(self, name):
        make = super().__getattr__(name)
        if name != "getMapState":
            return make
        store = self

        class Counting(Map):
            def __getattribute__(self, name):
                store.calls += name in ("containsKey", "getValue", "updateValue", "removeKey", "iterator")
                return super().__getattribute__(name)

        return lambda state, *schemas: self.states.setdefault(state, Counting())


def test_many_messages_take_few_calls_to_state():
    store = Counted()
    seen: dict[str, int] = {}
    rnd = random.Random(3)
    for batch in range(6):
        sights = LV.FirstSights(40.0)  # as after a restart
        sights.init(store)
        texts = [f"m{rnd.randrange(20_000)} \u00e9'\"" for _ in range((3, 5_000, 40, 9_000, 1, 3_000)[batch])]
        at = 10.0 * batch
        frame = pd.DataFrame({"event_time": pd.Timestamp(at, unit="s"), "ts": at, "span_id": [f"{i:06d}" for i in range(len(texts))], "service": "a", "masked": texts})
        got = [m for f in sights.handleInputRows((0,), iter([frame]), store) for m in f["masked"]]
        assert got == [t for t in dict.fromkeys(texts) if t not in seen]
        seen |= {t: int(at * 1000) for t in texts}
        if batch == 4:
            store.watermark = 55_000
            list(sights.handleExpiredTimer((0,), store, None))
            seen = {t: last for t, last in seen.items() if last > 15_000}
    assert len(seen) > 5_000 and store.calls < 1_000


def test_branches_and_leaves_take_few_calls_to_state():
    rnd = random.Random(4)
    texts = list(dict.fromkeys(" ".join(f"{c}{rnd.randrange(9)}" for c in "abcdefgh") for _ in range(4_000)))
    batches = [texts[:1], texts[1:2_000], texts[2_000:2_050], texts[2_050:]]

    def run(make, stores):
        out = []
        for k, batch in enumerate(batches):
            branch, leaf = ST.Branch(4, 5), ST.Leaf(0.55)
            branch.init(stores[0])
            leaf.init(stores[1])
            frame = pd.DataFrame({"event_time": None, "ts": [float(k * 10_000 + i) for i in range(len(batch))], "span_id": "", "service": "s", "masked": batch, "leaf": "8"})
            for routed in branch.handleInputRows((0,), iter([frame]), stores[0]):
                out += [x for f in leaf.handleInputRows((0,), iter([routed]), stores[1]) for x in zip(f["masked"], f["leaf"], f["grp"], f["is_new"])]
        return sorted(out)

    stores = Counted(), Counted()
    got = run(batches, stores)
    batches = [texts]
    whole = run(batches, (Counted(), Counted()))
    assert [x[:3] for x in got] == [x[:3] for x in whole] and sum(x[3] for x in got) == sum(x[3] for x in whole) > 1_000
    assert all(s.calls < 1_000 for s in stores)


def test_new_templates_are_numbered_by_slices():
    rnd = random.Random(9)
    rows = [{"event_time": pd.Timestamp(t, unit="s"), "ts": t, "tick_no": int(t // 2) + 1, "span_id": f"s{rnd.randrange(3)}", "service": None, "masked": f"m{i}", "is_new": rnd.random() < 0.8} for i, t in enumerate(rnd.choices(range(3, 400), k=900))]
    rows = [{**r, "slice": r["tick_no"] // 8} for r in rows]
    in_order = sorted(rows, key=lambda r: (r["tick_no"], r["ts"], r["span_id"], r["masked"]))
    new = [r for r in in_order if r["is_new"]]
    started = in_order[0]["ts"]
    want = [(r["tick_no"], r["tick_no"] * 2.0, i, None, r["masked"]) for i, r in enumerate(new, 1) if r["tick_no"] * 2.0 - started >= P.warmup_s]

    def through(make, store, rows, *keys):
        made, out = make(), []
        made.init(store)
        for key, group in pd.DataFrame(rows).groupby(list(keys)) if rows else ():
            out += [r for f in made.handleInputRows(key, iter([group.iloc[:1], group.iloc[1:]]), store) for r in f.to_dict("records")]
        return out

    store, got, met = Store(), [], 0
    for a, b in ((0, 21), (21, 90), (90, 250)):  # of ticks, a micro-batch each
        placed = through(LV.SliceOrder, store, [r for r in rows if a <= r["tick_no"] < b], "slice")
        met += sum(r["is_count"] for r in placed)
        started = through(LV.SliceStart, store, [{**r, "of": 0 if r["is_count"] else r["slice"]} for r in placed], "is_count", "of")
        got += [tuple(r.values()) for r in through(lambda: LV.SliceNumbers(P), store, started, "slice")]
    assert sorted(got, key=lambda r: r[2]) == want and len(want) > 500
    assert met <= 28  # rows that one key sees: slices and batches


# --- over streams ---------------------------------------------------------------------------

CLOSED = int((1200 - J.LATE_S) // P.tick_s) - 1


def test_streamed_graph_has_silent_ticks(spark, story):  # noqa: F811
    logs, folder = story
    got = J.run_once(J.live_graph(stream(spark, folder), P), "t").collect()
    want = G.edge_weights(G.edge_ticks(logs, P), R.tick_numbers(logs, P), P).collect()
    key = lambda rows: sorted((r.tick_no, r.source, r.target, round(r.weight, 9)) for r in rows if r.tick_no <= CLOSED)
    assert key(got) == key(want) and len(got) > 100


def test_streamed_correlation_is_the_batch_one(spark, story):  # noqa: F811
    """At each moment, what the batch gives as of the last bucket that ends by it."""
    logs, folder = story
    got = {}
    for r in J.run_once(J.live_correlation(stream(spark, folder), P), "t").collect():
        got.setdefault(r.moment, {})[r.service_a, r.service_b] = r["corr"]
    moments = sorted(got)
    assert moments == [moments[0] + P.correlation_s * k for k in range(len(moments))]
    assert moments[0] < 1000 + 2 * P.correlation_s and moments[-1] > 1200 - J.LATE_S - 2 * P.correlation_s
    replay = Replay(logs, P)
    for moment in (moments[0], moments[7], moments[len(moments) // 2], moments[-1]):
        want = {(r.service_a, r.service_b): r["corr"] for r in replay.correlation(moment - 0.5).collect()}
        assert got[moment] == pytest.approx(want, abs=1e-9)


def test_correlation_ends_with_the_window():
    """Moments go on over silence until the window is empty, in one step or many, and start anew."""
    rows = [(k, s, rate) for k in (5, 6, 9) for s, rate in (("a", 0.5), ("b", k / 10))] + [(200, "a", 1.0)]

    given = [rate(b + 1, s, error_rate=x) for b, s, x in rows]
    whole, store = drain(lambda: LV.CorrelationClock(P), [(given, 1000)])
    steps, held = drain(lambda: LV.CorrelationClock(P), [([r for r in given if r["tick_no"] == t + 3], t) for t in range(1, 400)])
    assert whole == steps
    assert not any(x.states["buckets"].exists() or x.states["told"].exists() for x in (store, held))
    moments = sorted({r[0] for r in whole})
    assert moments == [*range(6, 70, 3), *range(201, 261, 3)]
    assert {r[3] for r in whole if r[1] == r[2]} == {1.0}


class Steady(Replay):
    """The chain over detectors that give the same at every run: no forest."""

    @cached_property
    def anomalies(self):
        found = D.all_anomalies(D.rate_anomalies(R.zscores(self.ticks, self.p), self.p), D.rule_anomalies(self.rule_firings))
        return stage(D.with_blast_radius(found, self.topologies[0], self.blast), "anomalies")


def test_streamed_snapshots(spark, story, tmp_path):  # noqa: F811
    """One document per batch; the last is the batch's message over all rows. A batch that is
    tried again leaves one document and one copy of its rows."""
    logs, folder = story
    rows = L.read_log_stream(spark, folder, max_files=3)
    store, out, mark = (str(tmp_path / x) for x in ("store", "out", "mark"))

    def drain_all():
        query = J.start_snapshots(rows, store, out, mark, P, every=None, chain=Steady)
        query.awaitTermination()

    drain_all()
    assert [r.batch for r in spark.read.json(out).select("batch").orderBy("batch").collect()] == [0, 1]
    V.write_snapshot(V.snapshot(Steady(logs, P)), str(tmp_path / "whole"))

    def shown(df):
        return json.loads(df.select(F.to_json(F.struct(*sorted(df.columns))).alias("x")).first()["x"])

    want = shown(spark.read.json(str(tmp_path / "whole")))
    assert want["anomalies"] and want["logs"] and want["nodes"]
    assert shown(V.latest_snapshot(spark, out)) == want
    (tmp_path / "mark" / "commits" / "1").unlink()  # as if the driver had died before the last commit
    for crc in (tmp_path / "mark" / "commits").glob(".1.crc"):
        crc.unlink()
    before = L.read_logs(spark, store).count()
    drain_all()
    assert spark.read.json(out).count() == 2 and L.read_logs(spark, store).count() == before == logs.count()
    assert shown(V.latest_snapshot(spark, out)) == want


def test_streamed_incidents_are_the_batch_ones(spark, story):  # noqa: F811
    logs, folder = story
    rules = [("r", 1, "errors", "*", "error_rate", ">", 0.38, 4.0, True), ("s", 2, "b", "b", "p95_latency", ">", 480.0, 2.0, True)]
    got = J.run_once(J.live_incidents(stream(spark, folder), P, rules), "t").filter("event = 'member'").collect()
    r = Replay(logs, P, U.rules_frame(spark, rules))
    found = D.all_anomalies(D.rate_anomalies(R.zscores(r.ticks, P), P), D.rule_anomalies(r.rule_firings))
    members = N.assign_incidents(D.with_blast_radius(found, r.topologies[0], r.blast), P)
    first = members.groupBy("incident_id").agg(F.min(F.struct(*D.ORDER, "tick_no", "service")).alias("first"))
    want = members.join(first, "incident_id").filter(F.col("tick_no") <= CLOSED).collect()
    assert sorted((x.tick_no, x.kind, x.service, x.ord_3, x.first_tick_no, tuple(x.reached)) for x in got if x.tick_no <= CLOSED) == sorted(
        (x.tick_no, x.kind, x.service, x.ord_3, x.first.tick_no, tuple(x.blast_radius)) for x in want
    )
    assert want


def test_newest_logs_are_cut_before_they_are_masked(story, capsys):  # noqa: F811
    chain = Replay(story[0], P)
    got = V.newest_logs(chain, 9)
    want = reads.recent_logs(chain.logs, 9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("template_id > 0").count() == 9

    def below_the_limit(df):
        df.explain()
        return capsys.readouterr().out.split("== Initial Plan ==")[-1].split("TakeOrderedAndProject", 1)[1]

    assert "regexp_replace" in below_the_limit(want) and "regexp_replace" not in below_the_limit(got)


def test_streamed_forest_is_the_batch_one(spark, story):  # noqa: F811
    logs, folder = story
    p = Params(forest_min_rows=2, trees=20)
    got = close(J.run_once(J.live_outliers(J.sliding_rates(stream(spark, folder), p), p), "t").collect(), "tick_no", "service", "is_outlier")
    batch = I.forest_per_tick(R.feature_matrix(R.service_ticks(logs, p, ("p95",))), p).collect()
    want = close([r for r in batch if r.tick_no <= max(k[0] for k in got)], "tick_no", "service", "is_outlier")
    assert got == want and len(got) > 100


def test_streamed_new_templates_are_the_batch_ones(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(float(t), f"{i:06d}", rnd.choice(["a", "b", None]), " ".join(rnd.choices("uvwxyz", k=rnd.choice([0, 3, 5])))) for i, t in enumerate(sorted(rnd.choices(range(1000), k=600)))]
    schema = "ts double, span_id string, service string, message string"
    for k in range(3):
        spark.createDataFrame(rows[200 * k : 200 * k + 200], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = J.run_once(J.live_new_templates(source, P), "t").collect()
    logs = spark.createDataFrame(rows, schema)
    want = M.new_templates(M.mine_templates(logs, P)[0], P, rows[0][0]).select("tick_no", "tick", "template_id", "service", "first_text")
    last = int((rows[-1][0] - J.LATE_S) // P.tick_s)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.filter(F.col("tick_no") <= last).collect())) and len(got) > 20
