import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import replicas
from signalgraph.sources.staging import stage
from signalgraph import Params
from signalgraph.functions.ordered import number_rows
from signalgraph.operators import correlation as C
from signalgraph.operators import detect as D
from signalgraph.operators import forecast as E
from signalgraph.operators import graph as G
from signalgraph.operators import iforest as I
from signalgraph.operators import incidents as N
from signalgraph.operators import rates as R
from signalgraph.operators import reads
from signalgraph.operators import rules as U
from signalgraph.operators import templates as M
from signalgraph.operators import traces as T

P = Params()


def numbered(spark, last, tick=2.0):
    return spark.createDataFrame([(i, i * tick, i) for i in range(1, last + 1)], "tick_no long, tick double, seq long")


def tick_rows(spark, rows, value):
    """rows of (tick_no, service, value) as per-tick aggregates."""
    return spark.createDataFrame([(t, t * 2.0, s, v) for t, s, v in rows], f"tick_no long, tick double, service string, {value} double")


# --- rates ---------------------------------------------------------------


def test_ticks_cover_the_last_window(make_logs):
    rng = random.Random(3)
    rows = [(rng.uniform(1000, 1300), rng.choice("aab"), rng.choice(["INFO", "ERROR", "WARN"]), rng.uniform(1, 500)) for _ in range(400)]
    logs = make_logs([{"ts": t, "service": s, "level": l, "latency_ms": x} for t, s, l, x in rows])
    want = replicas.ticks(rows, P.window_s, P.tick_s)
    got = {(r.tick_no, r.service): r for r in R.service_ticks(logs, P).collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        xs = [x for _, _, _, x in want[key]]
        assert r.total == len(xs) and r.errors == sum(l == "ERROR" for _, _, l, _ in want[key])
        assert r.p95 == pytest.approx(replicas.quantile(xs, 0.95)) and r.mean_lat == pytest.approx(np.mean(xs))
    lean = {(r.tick_no, r.service): r for r in R.service_ticks(logs, P, ()).collect()}
    assert {k: (r.total, r.errors) for k, r in lean.items()} == {k: (r.total, r.errors) for k, r in got.items()}


def test_results_ignore_partitioning_and_row_order(make_logs):
    rng = random.Random(4)
    rows = [{"ts": rng.uniform(0, 90), "service": rng.choice("abc"), "latency_ms": rng.uniform(0, 9)} for _ in range(300)]
    logs = make_logs(rows)
    shuffled = logs.orderBy(F.rand(1)).repartition(13)
    for op in (lambda x: R.service_ticks(x, P), lambda x: R.timeline(x, P, 89.5), lambda x: R.latency_series(x, P, 89.5)):
        a, b = [sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in op(x).collect()) for x in (logs, shuffled)]
        assert a == b


def test_timeline_fills_empty_buckets(make_logs):
    logs = make_logs([{"ts": 100.2, "service": "a", "level": "ERROR"}, {"ts": 102.9, "service": "a", "level": "WARN"}])
    got = R.timeline(logs, P).orderBy("ts").collect()
    assert len(got) == 60 and got[-1].ts == 102.0
    assert [(r.total, r.errors, r.warns) for r in got[-3:]] == [(1, 1, 0), (0, 0, 0), (1, 0, 1)]
    series = R.latency_series(logs, P, service="nobody").collect()
    assert len(series) == 60 and {r.p95 for r in series} == {0.0}


def test_rolling_z_includes_the_current_sample(spark):
    def last_z(zeros):
        rows = [(i, "a", 0.0) for i in range(1, zeros + 1)] + [(zeros + 1, "a", 5.0)]
        got = R.zscores(tick_rows(spark, rows, "errors"), P, ("errors",)).orderBy("tick_no").collect()
        return got[-1].z_errors

    assert last_z(16) == pytest.approx(4.0)
    assert last_z(8) == pytest.approx(math.sqrt(8))
    assert last_z(6) == 0.0


def test_rate_anomalies(spark):
    rows = [(i, "a", 1.0 if i % 2 else 2.0, 1, 50.0, 1) for i in range(1, 40)] + [(40, "a", 40.0, 12, 500.0, 12)]
    ticks = spark.createDataFrame(
        [(t, t * 2.0, s, int(n), e, lat) for t, s, n, e, lat, _ in rows],
        "tick_no long, tick double, service string, total long, errors int, p95 double",
    )
    got = D.rate_anomalies(R.zscores(ticks, P), P).orderBy("ord_3").collect()
    assert [r.tick_no for r in got] == [40, 40, 40]
    assert got[0].description.startswith("error burst: 12 errors, z=6.")
    assert got[1].description.startswith("p95 latency jump to 500ms, z=6.")
    assert got[2].description.startswith("log volume spike: 40 logs, z=6.")
    assert all(r.severity == 1.0 for r in got)


# --- forecast, correlation, forest ------------------------------------------


def test_forecast(spark):
    xs = [0.0, 0.1, 0.4, 0.1]
    got = E.forecast(tick_rows(spark, [(i, "a", x) for i, x in enumerate(xs)], "error_rate"), P).orderBy("tick_no").collect()
    assert [r.forecast for r in got] == pytest.approx([0.0, 0.035, 0.16275, 0.1407875])
    assert [r.variance for r in got] == pytest.approx([0.0, 0.0035, 0.04890375, 0.03316558], abs=1e-8)


def test_forecast_equals_the_full_fold_on_long_series(spark):
    rng = random.Random(9)
    xs = [rng.random() for _ in range(400)]
    mean, var = xs[0], 0.0
    for x in xs[1:]:
        var = 0.35 * (x - mean) ** 2 + 0.65 * var
        mean = 0.35 * x + 0.65 * mean
    frame = tick_rows(spark, [(i, "a", x) for i, x in enumerate(xs)], "error_rate")
    got = E.forecast_now(frame, P).first()
    assert got.forecast == pytest.approx(mean, rel=1e-14) and got.stddev == pytest.approx(math.sqrt(var), rel=1e-14)


def test_forecast_over_several_slices_and_a_decaying_series(spark):
    xs = [1.0] + [0.0] * 149
    decayed = E.forecast_now(tick_rows(spark, [(i, "a", x) for i, x in enumerate(xs)], "error_rate"), P).first()
    assert decayed.forecast == pytest.approx(0.65**149, rel=1e-9)
    rng = random.Random(4)
    for p in (P, Params(ewma_alpha=0.01)):
        xs = [rng.random() for _ in range(2 * E.SLICE_TICKS + 50)]
        want, mean, var = {}, xs[0], 0.0
        for i, x in enumerate(xs):
            var = p.ewma_alpha * (x - mean) ** 2 + (1 - p.ewma_alpha) * var
            mean = p.ewma_alpha * x + (1 - p.ewma_alpha) * mean
            want[i] = mean, var
        got = E.forecast(tick_rows(spark, [(i, "a", x) for i, x in enumerate(xs)], "error_rate"), p).collect()
        assert len(got) == len(xs)
        for r in got[:: 50] + got[-60:]:
            assert (r.forecast, r.variance) == pytest.approx(want[r.tick_no], rel=1e-9)


def test_correlation(spark):
    series = {"x": [0, 1, 0, 1, 0.5, 0], "y": [0, 1, 0, 0.5, 0, 0], "k": [0] * 6, "flat": [0.1] * 6}
    rates = spark.createDataFrame(
        [(s, 100 + i, float(v)) for s, vs in series.items() for i, v in enumerate(vs) if v or s == "k"],
        "service string, bucket long, rate double",
    )
    got = {(r.service_a, r.service_b): round(r["corr"], 3) for r in C.correlation(rates, 100, 106).collect()}
    assert len(got) == 16
    assert got["x", "y"] == got["y", "x"] == 0.851
    assert all(got[s, s] == 1.0 for s in series)
    assert all(got[a, b] == 0.0 for a in ("k", "flat") for b in series if a != b)
    few = {(r.service_a, r.service_b): r["corr"] for r in C.correlation(rates, 100, 102).collect()}
    assert few["x", "y"] == 0.0 and few["x", "x"] == 1.0


def features(spark, per_tick, odd_tick):
    rng = random.Random(2)
    rows = []
    for t in range(1, 4):
        for i in range(per_tick):
            row = [100 + rng.randrange(9), rng.randrange(3), rng.randrange(3), 20 + rng.random(), 60 + rng.random(), 0.02]
            if t == odd_tick and i == 5:
                row = [9000, 4000, 100, 900.0, 5000.0, 0.9]
            rows.append((t, t * 2.0, f"s{i:03d}", *map(float, row)))
    return spark.createDataFrame(rows, "tick_no long, tick double, service string, " + ", ".join(f"{c} double" for c in R.FEATURES))


def test_forest_flags_the_planted_outlier(spark):
    got = I.forest_per_tick(features(spark, 14, 2), P)
    assert got.filter("is_outlier").groupBy("tick_no").count().filter("count <> 1").count() == 0
    lowest = got.filter("tick_no = 2").orderBy("decision").first()
    assert lowest.service == "s005" and lowest.is_outlier and lowest.decision < -0.1
    assert I.forest_per_tick(features(spark, 5, 2), P).count() == 0
    again = I.forest_per_tick(features(spark, 14, 2).repartition(5), P)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_forest_is_that_of_each_tick(spark, capsys):
    rows = features(spark, 14, 2)
    found = I.forest_per_tick(rows.repartition(7), P)
    got = {(r.tick_no, r.service): (r.decision, r.is_outlier) for r in found.collect()}
    want = {}
    for _, pdf in rows.toPandas().groupby("tick_no"):
        for r in I.tick_decisions(pdf, P).itertuples():
            want[r.tick_no, r.service] = (r.decision, r.is_outlier)
    assert got == want and len(got) == 14 * 3
    found.explain()
    assert "FlatMapGroupsInPandas" not in capsys.readouterr().out  # no frame for each tick


def test_pooled_forest(spark):
    got = I.pooled_forest(features(spark, 400, 2), ["tick_no", "service"], P)
    flagged = got.filter("is_outlier").collect()
    assert 0.05 * 1200 <= len(flagged) <= 0.06 * 1200 + 1
    assert got.orderBy("decision").first().service == "s005"


def test_mean_path_length():
    assert list(I.mean_path(np.array([1, 2]))) == [0.0, 1.0]
    assert I.mean_path(np.array([256]))[0] == pytest.approx(10.2448, abs=1e-3)


# --- rules -------------------------------------------------------------------

RULE = [("r", 1, "errors", "*", "error_rate", ">", 0.08, 4.0, True)]


def rule_ticks(spark, rows):
    return spark.createDataFrame(
        [(int(t / 2), float(t), s, int(n), e, 10.0) for t, s, n, e in rows],
        "tick_no long, tick double, service string, total long, error_rate double, p95 double",
    )


def fire(spark, ticks, rules, **how):
    seq = number_rows(ticks.select("tick_no", "tick").distinct(), "tick_no", [], "seq", 4)
    return U.rule_firings(U.rule_dwell(U.rule_matches(ticks, rules, P, **how), seq)).orderBy("tick").collect()


def test_dwell_and_severity(spark):
    rates = {2: 0.1, 4: 0.1, 6: 0.1, 8: 0.1, 10: 0.0, 12: 0.1, 14: 0.1, 16: 0.1, 18: 0.1}
    got = fire(spark, rule_ticks(spark, [(t, "a", 9, x) for t, x in rates.items()]), U.rules_frame(spark, RULE))
    assert [(r.tick, r.fired_count, round(r.severity, 2)) for r in got] == [(6.0, 1, 0.6), (16.0, 2, 0.65)]
    text = D.rule_anomalies(spark.createDataFrame(got)).first().description
    assert text == "rule · errors (observed 10.0%)"


def test_one_dwell_per_rule_but_per_service_on_request(spark):
    rows = [(t, s, n, 0.5 if s == on else 0.0) for t, on in [(2, "a"), (4, "b"), (6, "a")] for s, n in (("a", 5), ("b", 9))]
    ticks = rule_ticks(spark, rows)
    assert [(r.tick, r.service) for r in fire(spark, ticks, U.rules_frame(spark, RULE))] == [(6.0, "a")]
    assert fire(spark, ticks, U.rules_frame(spark, RULE), per_service=True) == []


def test_firings_match_the_loop(spark):
    rng = random.Random(8)
    rows = [(2 * i, s, rng.randrange(1, 50), rng.choice([0.0, 0.05, 0.2])) for i in range(1, 200) for s in "abc" if rng.random() < 0.5]
    matching = {}
    present = sorted({t for t, *_ in rows})
    for t, _, _, x in rows:
        if x > 0.08:
            matching[present.index(t)] = float(t)
    want = [float(present[i]) for i in replicas.firings(matching, 4.0)]
    assert [r.tick for r in fire(spark, rule_ticks(spark, rows), U.rules_frame(spark, RULE))] == want
    assert len(want) > 3


def test_rule_changes(spark):
    body = (1, "errors", "*", "error_rate", ">", 0.08, 4.0)
    none = (None,) * 7
    changes = spark.createDataFrame(
        [(1.0, "r", "add", *body), (7.0, "r", "disable", *none), (11.0, "r", "enable", *none), (19.0, "r", "delete", *none)],
        "change_ts double, rule_id string, change string, position int, name string, service string, metric string, "
        "op string, threshold double, duration_s double",
    )
    ticks = rule_ticks(spark, [(t, "a", 9, 0.5) for t in range(2, 40, 2)])
    assert [(r.tick, r.fired_count) for r in fire(spark, ticks, U.rule_versions(changes))] == [(6.0, 1), (16.0, 2)]
    state = lambda at: [(r.rule_id, r.enabled) for r in U.rules_effective(changes, at).collect()]
    assert [state(0.5), state(5.0), state(8.0), state(12.0), state(30.0)] == [[], [("r", True)], [("r", False)], [("r", True)], []]


def test_unknown_operator_never_matches(spark):
    rules = U.rules_frame(spark, [("r", 1, "n", "*", "error_rate", "==", 0.5, 0.0, True)])
    assert U.rule_matches(rule_ticks(spark, [(2, "a", 9, 0.5)]), rules, P).count() == 0


# --- traces and reads ---------------------------------------------------------


def test_trace_depth(make_logs):
    rows = [(1, "gateway", None), (2, "auth", "gateway"), (3, "sessions", "auth"), (4, "catalog", "search"), (5, "inventory", "catalog")]
    logs = make_logs([{"ts": float(t), "service": s, "parent_service": p} for t, s, p in rows])
    assert [r.depth for r in T.trace_spans(logs, "t").collect()] == [0, 1, 2, 0, 1]


def test_trace_depth_matches_the_loop(make_logs):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        trace = "hot" if rng.random() < 0.4 else f"t{rng.randrange(40)}"
        rows.append({"ts": float(rng.randrange(30)), "trace_id": trace, "span_id": f"s{i:04d}", "service": rng.choice("abcdef"), "parent_service": rng.choice([None, *"abcdefx"])})
    got = {r.span_id: r.depth for r in T.trace_depth(make_logs(rows)).collect()}
    for trace in {r["trace_id"] for r in rows}:
        mine = sorted((r["ts"], r["span_id"], r["service"], r["parent_service"]) for r in rows if r["trace_id"] == trace)
        assert [got[s] for _, s, _, _ in mine] == replicas.depths(mine)


def test_trace_summary_and_waterfall(make_logs):
    logs = make_logs(
        [
            {"ts": 1.0, "service": "b", "latency_ms": 1000.0, "span_id": "s1"},
            {"ts": 1.5, "service": "a", "latency_ms": 1500.0, "level": "FATAL", "span_id": "s2"},
            {"ts": 9.0, "service": "z", "trace_id": "instant", "span_id": "s3"},
        ]
    )
    s = {r.trace_id: r for r in T.trace_summary(logs).collect()}
    assert (s["t"].started, s["t"].duration_ms, s["t"].services, s["t"].has_errors) == (1.0, 2000.0, ["a", "b"], True)
    w = {r.span_id: r for r in T.trace_waterfall(logs).collect()}
    assert (w["s2"].offset_ms, w["s2"].left_pct, w["s2"].width_pct) == (500.0, 25.0, 75.0)
    assert (w["s3"].left_pct, w["s3"].width_pct) == (0.0, 1.2)


def test_search(make_logs):
    logs = make_logs(
        [
            {"ts": 100.0, "service": "a", "message": "Card DECLINED 50%"},
            {"ts": 101.0, "service": "b", "message": "card declined"},
            {"ts": 102.0, "service": "a", "message": "ok", "level": "WARN"},
            {"ts": 10.0, "service": "a", "message": "card declined long ago"},
        ]
    )
    ids = lambda *a, **k: [r.ts for r in reads.search_logs(logs, P, *a, **k).collect()]
    assert ids("DECLINED") == [101.0, 100.0]
    assert ids("c_rd%ed", service="a", level="*") == [100.0]
    assert ids("", limit=2) == [102.0, 101.0]
    assert reads.search_total(logs, P, "", service="*").first().total_matches == 3
    assert reads.search_total(logs, P, "zzz").first().total_matches == 0
    assert [r.ts for r in reads.recent_problems(logs, P, "a").collect()] == [102.0]


# --- templates -----------------------------------------------------------------


def mined(make_logs, messages, p=P):
    logs = make_logs([{"ts": float(i // 3), "service": f"s{i % 2}", "message": m} for i, m in enumerate(messages)])
    templates, assigned = M.mine_templates(logs, p)
    ids = {r.span_id: r.template_id for r in M.assign_templates(logs, assigned).collect()}
    return [ids[k] for k in sorted(ids)], templates.orderBy("template_id").collect(), logs, templates


def test_template_fold(make_logs):
    messages = ["a b c d x y", "a b c d z y", "a b c d q w", "a b c e x y", "a b c d", "  "]
    ids, found, _, _ = mined(make_logs, messages)
    assert ids == [1, 1, 1, 2, 3, 0]
    assert [(r.template_id, r.template, r["count"]) for r in found] == [(1, "a b c d <*> <*>", 3), (2, "a b c e x y", 1), (3, "a b c d", 1)]


@pytest.mark.parametrize("children", [2, 3, 100])
def test_templates_match_the_loop(make_logs, children):
    rng = random.Random(children)
    messages = []
    for i in range(900):
        words = [rng.choice("pqrst") for _ in range(rng.randrange(1, 8))]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = str(i)
        messages.append(" ".join(words))
    messages = list(dict.fromkeys(messages))  # a repeat may be counted to an earlier group
    p = Params(template_children=children)
    ids, found, _, _ = mined(make_logs, messages, p)
    masked_first, want, texts = set(), *replicas.mine(messages, p.template_similarity, 4, children)
    assert [r.template for r in found] == texts
    seen = {}
    for m, got, exp in zip(messages, ids, want):
        key = replicas.re.sub(replicas.PARAMETER_PATTERN, "<*>", m)
        if key not in seen:  # the first of each masked text is exact
            seen[key] = got
            assert got == exp
    assert sum(r["count"] for r in found) == len(messages)


def plain_groups(messages, threshold):
    """Greedy grouping with every group compared."""
    groups, out = [], []
    for words in messages:
        alike = [sum(g in (w, "<*>") for g, w in zip(group, words)) / len(words) for group in groups]
        best = max(range(len(groups)), key=lambda k: (alike[k], -k), default=None)
        if best is not None and alike[best] >= threshold:
            groups[best] = [g if g == w else "<*>" for g, w in zip(groups[best], words)]
            out.append((best, False))
        else:
            groups.append(words)
            out.append((len(groups) - 1, True))
    return out, [" ".join(g) for g in groups]


@pytest.mark.parametrize("threshold", [0.4, 0.55, 0.8, 1.0])
def test_listed_groups_match_the_loop(threshold, monkeypatch):
    monkeypatch.setattr(M.LeafGroups, "LISTED", 2)
    draw = random.Random(7)
    for width in range(1, 14):
        base = [[f"w{draw.randrange(12)}" for _ in range(width)] for _ in range(25)]
        messages = [[w if draw.random() < 0.7 else draw.choice(["<*>", f"w{draw.randrange(12)}"]) for w in draw.choice(base)] for _ in range(200)]
        groups = M.LeafGroups()
        got = [groups.add(list(m), threshold) for m in messages]
        assert (got, list(groups.texts())) == plain_groups(messages, threshold)


def test_few_groups_of_a_large_leaf_are_compared():
    draw = random.Random(8)
    groups = M.LeafGroups()
    messages = [[f"w{draw.randrange(300)}" for _ in range(12)] for _ in range(3000)]
    for m in messages:
        groups.add(m, 0.55)
    assert groups.size > 2900
    asked = [groups._asked(groups._coded(m), 0.55) for m in messages]
    assert all(a is not None for a in asked) and sum(map(len, asked)) < 20 * len(messages)


def test_new_templates_after_warm_up(make_logs):
    messages = ["start up"] * 60 + ["disk failed on node"] * 20 + ["start up"] * 20
    _, _, logs, templates = mined(make_logs, messages, Params())
    got = M.new_templates(templates, Params(warmup_s=15.0), 0.0).collect()
    assert [(r.tick, r.service, r.first_text) for r in got] == [(22.0, "s0", "disk failed on node")]
    signal = D.template_anomalies(M.new_templates(templates, Params(warmup_s=15.0), 0.0)).first()
    assert signal.description == 'new log template: "disk failed on node"' and signal.severity == 0.6


def test_template_explorer(make_logs):
    logs = make_logs(
        [
            {"ts": 100.0 + i, "service": "a", "level": level, "message": f"m{i}", "template_id": t}
            for i, (t, level) in enumerate([(1, "FATAL"), (1, "WARN"), (1, "INFO"), (2, "ERROR"), (None, "INFO")])
        ]
    )
    got = M.template_explorer(logs, P).collect()
    assert [(r.template_id, r["count"], r.level, r.top_level, r.example) for r in got] == [(1, 3, "WARN", "FATAL", "m0"), (2, 1, "ERROR", "ERROR", "m3")]
    assert [round(r.bar_pct, 1) for r in got] == [100.0, 33.3]
    assert [r.place for r in M.top_templates_by_service(logs, P, 1).collect()] == [1]


# --- graph and incidents ----------------------------------------------------------


def test_edge_decay(spark):
    calls = spark.createDataFrame([("a", "b", 1, 3), ("a", "b", 34, 1)], "source string, target string, tick_no long, calls long")
    got = {r.tick_no: r.weight for r in G.edge_weights(calls, numbered(spark, 40), P).collect()}
    assert [got[i] for i in (1, 2, 3)] == pytest.approx([3, 2.76, 2.5392])
    assert got[28] == pytest.approx(0.3157858, abs=1e-7) and 29 not in got and got[34] == 1.0


def test_edge_weights_match_the_loop(spark):
    rng = random.Random(7)
    calls = {(a, b, s): rng.randrange(1, 9) for a, b in ["ab", "bc", "ca"] for s in range(1, 200) if rng.random() < 0.05}
    frame = spark.createDataFrame([(*k, n) for k, n in calls.items()], "source string, target string, tick_no long, calls int")
    got = {(r.source, r.target, r.tick_no): r.weight for r in G.edge_weights(frame, numbered(spark, 200), P).collect()}
    assert got == pytest.approx(replicas.edge_weights(calls, 200, P.edge_decay, P.edge_floor))


def test_blast_radius_on_a_cycle(spark):
    edges = spark.createDataFrame([("t", a, b) for a, b in ["ab", "bc", "ca", "cd", "de", "ef"]], "topology string, source string, target string")
    hops = {(r.source, r.service): r.hops for r in G.reach(edges, 4).collect()}
    assert {k[1]: v for k, v in hops.items() if k[0] == "a"} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert ("a", "f") in {(r.source, r.service) for r in G.reach(edges, 5).collect()}
    row = G.blast_radius(G.reach(edges, 4)).filter("source = 'c'").first()
    assert row.blast_radius == ["c", "a", "d", "b", "e", "f"] and row.blast_hops["f"] == 3
    anomalies = spark.createDataFrame([(1, "z"), (1, "a")], "tick_no long, service string")
    ticks = spark.createDataFrame([(1, "t")], "tick_no long, topology string")
    got = {r.service: r for r in D.with_blast_radius(anomalies, ticks, G.blast_radius(G.reach(edges, 4))).collect()}
    assert got["z"].blast_radius == ["z"] and got["z"].blast_hops == {"z": 0}
    assert got["a"].blast_radius == ["a", "b", "c", "d", "e"]


def anomaly_frame(spark, rows):
    full = [
        (i, f"a{n:04d}", int(ts // 2), float(ts), "rate_spike", s, float(sev), f"d{n}", 0, 0.0, s, n, list(blast), blast)
        for n, (i, ts, s, sev, blast) in enumerate((None, *r) for r in rows)
    ]
    return spark.createDataFrame(
        [r[1:] for r in full],
        "anomaly_id string, tick_no long, tick double, kind string, service string, severity double, description string, "
        "detector_ord int, ord_1 double, ord_2 string, ord_3 int, blast_radius array<string>, blast_hops map<string,int>",
    )


@pytest.fixture(scope="module")
def story(spark):
    anomalies = anomaly_frame(
        spark,
        [
            (0, "payments", 0.7, {"payments": 0, "ledger": 1}),
            (2, "checkout", 0.6, {"checkout": 0, "payments": 1, "ledger": 2}),
            (4, "search", 0.5, {"search": 0, "catalog": 1}),
            (6, "ledger", 0.9, {"ledger": 0}),
            (40, "payments", 0.8, {"payments": 0, "ledger": 1}),
        ],
    )
    edges = spark.createDataFrame(
        [("t", "checkout", "payments"), ("t", "payments", "ledger"), ("t", "search", "catalog")],
        "topology string, source string, target string",
    )
    ticks = spark.createDataFrame([(i, "t") for i in range(40)], "tick_no long, topology string")
    return N.assign_incidents(anomalies, P), ticks, G.reach(edges, P.root_depth)


def test_incident_story(story):
    members, ticks, reached = story
    of = {r.anomaly_id: r.incident_id for r in members.collect()}
    a, b, c = of["a0000"], of["a0002"], of["a0004"]
    assert of == {"a0000": a, "a0001": a, "a0002": b, "a0003": a, "a0004": c} and len({a, b, c}) == 3
    records = N.incident_records(members, ticks, reached, P)
    by = {r.incident_id: r for r in records.collect()}
    assert by[a].root_service == "ledger" and by[a].title == "ledger incident · 3 services"
    assert by[a].impact == ["checkout", "ledger", "payments"] and by[a].impact_hops == {"checkout": 0, "ledger": 0, "payments": 0}
    assert (by[a].severity, by[a].suspected_cause, by[a].anomaly_count) == (0.9, "d3", 3)
    assert by[a].anomaly_ids == ["a0000", "a0001", "a0003"]
    assert by[b].title == "search · rate spike×1" and by[b].impact == ["search", "catalog"]
    ranked = {r.service: r.score for r in N.root_ranking(members, ticks, reached, P).filter(F.col("incident_id") == a).collect()}
    assert ranked == {"ledger": 201.5, "payments": 101.0, "checkout": 0.0}
    state = lambda at: {r.incident_id: r.state for r in N.incident_board(records, at, P).collect()}
    early = N.incident_records(members.filter("tick <= 30"), ticks, reached, P)
    assert {r.state for r in N.incident_board(early, 30.0, P).collect()} == {"resolving"}
    assert state(52.0) == {a: "resolved", b: "resolved", c: "active"}
    assert a not in state(352.0) and c in state(352.0)
    board = N.incident_board(records, 52.0, P)
    assert [r.incident_id for r in N.active_incidents(board).collect()] == [c]
    assert N.panel_order(board).first().incident_id == c and N.focus_incident(board).first().incident_id == c
    assert N.active_count(board).first().active_incidents == 1


def test_root_after_two_members(story):
    members, ticks, reached = story
    two = N.incident_records(members.filter("tick <= 2"), ticks, reached, P).collect()
    assert [r.root_service for r in two] == ["payments"]


def test_incidents_match_the_loop(spark):
    rng = random.Random(11)
    near = {"a": "ab", "b": "bc", "c": "c", "x": "xy", "y": "y", "q": "q"}
    rows, ts = [], 0
    for _ in range(600):
        ts += rng.choice([0, 0, 2, 2, 4, 20, 24, 26, 60])
        s = rng.choice(list(near))
        rows.append((ts, s, rng.random(), {m: i for i, m in enumerate(near[s])}))
    frame = anomaly_frame(spark, rows).repartition(6)
    got = {r.anomaly_id: r.incident_id for r in N.assign_incidents(frame, P).collect()}
    in_order = sorted((float(ts), s, n) for n, (ts, s, _, _) in enumerate(rows))
    want = replicas.incidents([(f"a{n:04d}", ts, s, near[s]) for ts, s, n in in_order], P.correlation_gap_s)
    pairs = {(got[k], want[k]) for k in want}
    assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})
    assert len(pairs) > 20


def test_zscores_across_slices_of_samples(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, s, float(rng.randrange(50))) for s in "ab" for i in sorted(rng.sample(range(4000), 400))]
    frame = spark.createDataFrame(rows, "tick_no long, service string, total double")
    whole = {(r.tick_no, r.service): (r.samples, r.z_total) for r in R.zscores(frame, P, ("total",)).collect()}
    monkeypatch.setattr(R, "SAMPLE_SLICE", 70)
    cut = {(r.tick_no, r.service): (r.samples, r.z_total) for r in R.zscores(frame, P, ("total",)).collect()}
    assert len(whole) == 800 and cut.keys() == whole.keys()
    assert all(cut[k] == pytest.approx(whole[k]) for k in whole)


def test_a_second_run_goes_on_from_open_incidents(spark):
    rng = random.Random(12)
    near = {"a": "ab", "b": "bc", "c": "c", "x": "xy", "y": "y", "q": "q"}
    rows, ts = [], 0
    for _ in range(300):
        ts += rng.choice([0, 2, 2, 4, 20, 24, 26])
        s = rng.choice(list(near))
        rows.append((ts, s, rng.random(), {m: i for i, m in enumerate(near[s])}))
    frame = anomaly_frame(spark, rows)
    whole = {r.anomaly_id: r.incident_id for r in N.assign_incidents(frame, P).collect()}
    cut, later = rows[100][0], rows[200][0]
    runs, opened = {}, None
    for low, high in ((-1, cut), (cut, later), (later, 10**9)):
        part = frame.filter((F.col("tick") > low) & (F.col("tick") <= high))
        members = N.assign_incidents(part, P, opened=opened)
        opened = stage(N.open_incidents(members, P, opened=opened), "open")
        runs |= {r.anomaly_id: r.incident_id for r in members.collect()}
    assert runs == whole


def test_linked_services(spark):
    chain = [(0, "s%02d" % k, 0.5, {"s%02d" % k: 0, "s%02d" % (k + 1): 1}) for k in range(9)] + [(0, "x", 0.5, {"x": 0, "y": 1})]
    got = {r.service: r.linked for r in N.linked_services(anomaly_frame(spark, chain), ["tick"]).collect()}
    assert got == {**{f"s{k:02d}": "s00" for k in range(10)}, "x": "x", "y": "x"}


def test_tenants_never_share_incidents(spark):
    rows = anomaly_frame(spark, [(t, "a", 0.5, {"a": 0}) for t in (0, 2, 4, 6)])
    rows = rows.withColumn("env", F.when(F.col("tick") % 4 == 0, "one").otherwise("two"))
    got = N.assign_incidents(rows, P, by=["env"])
    assert got.groupBy("env").agg(F.countDistinct("incident_id").alias("n")).filter("n <> 1").count() == 0
    assert got.select("incident_id").distinct().count() == 2


def test_incident_subgraph(story, spark):
    members, _, _ = story
    impact = N.incident_impact(members).withColumn("is_root", F.col("service") == "ledger")
    edges = spark.createDataFrame([("checkout", "payments", 1.0), ("search", "checkout", 1.0)], "source string, target string, weight double")
    got = G.incident_subgraph(impact, edges).collect()
    assert [(r.source, r.target) for r in got] == [("checkout", "payments")]
    assert got[0].source_label is None


def test_anomaly_load(spark):
    rows = anomaly_frame(spark, [(10, "a", 0.5, {"a": 0}), (10, "b", 0.5, {"b": 0}), (40, "a", 0.5, {"a": 0})])
    got = {r.tick_no: r.anomalies_recent for r in D.anomaly_load(rows, numbered(spark, 60), P).collect()}
    assert (got[4], got[5], got[20], got[35], got[36], got[50], got[51]) == (0, 2, 3, 3, 1, 1, 0)


def test_node_state(spark):
    ticks = spark.createDataFrame(
        [(1, 2.0, "a", 60, 0.1, 30.0, 80.0), (3, 6.0, "a", 30, 0.0, 10.0, 8000.0)],
        "tick_no long, tick double, service string, total long, error_rate double, mean_lat double, p95 double",
    )
    metrics = G.node_metrics(ticks, P)
    history = {r.tick_no: r.health for r in G.node_history(metrics, numbered(spark, 4)).collect()}
    assert history == pytest.approx({1: 0.72, 2: 0.72, 3: 0.4, 4: 0.4})
    calls = spark.createDataFrame([("caller", "a", 1, 1)], "source string, target string, tick_no long, calls long")
    nodes = {r.service: r for r in G.nodes_at(metrics, calls, 4).collect()}
    assert nodes["caller"].health == 1.0 and nodes["a"].logs_per_min == 30.0 and nodes["a"].grp == "other"
