import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import replicas
from signalgraph.functions import scalars as S
from signalgraph.functions.ordered import chain_by_gap, lookup, number_rows
from signalgraph.functions.quantiles import value_bin, window_rollup
from signalgraph.operators.graph import edge_ticks
from signalgraph.params import Params
from signalgraph.sources.adapters import event_logs


@pytest.mark.parametrize(
    "message, masked",
    [
        ("charge authorized amount=12.50 currency=USD", "charge authorized amount=<*> currency=USD"),
        ("facade built in 12ms", "<*> built in <*>ms"),
        ("GET /api/v1/cart handled in 8.1ms status=200", "GET /api/v<*>/cart handled in <*>ms status=<*>"),
        ("id_deadbeef01 p_12 sku_Ab9 sess_zz9 u_77", "<*> <*> <*> <*> <*>"),
        ("  ", ""),
        ("a b\x1cc d", "a b c d"),
    ],
)
def test_masking(spark, message, masked):
    row = spark.createDataFrame([(message,)], "message string").select(
        F.concat_ws(" ", S.tokens(S.mask("message"))).alias("m")
    )
    assert row.first().m == masked


def test_scalars(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (10, 3, 900.0, 4.5)], "total long, errors long, p95 double, z double")
    got = df.select(
        S.ratio("errors", "total").alias("r"),
        S.health(S.ratio("errors", "total"), "p95").alias("h"),
        S.z_severity("z", 3.0).alias("s"),
        S.per_minute("total", 60).alias("m"),
        S.tone(S.ratio("errors", "total"), 0.05, 0.02).alias("t"),
    ).collect()
    assert tuple(got[0]) == (0.0, 1.0, 0.0, 0.0, "good")
    assert got[1].r == 0.3 and got[1].h == 0.0 and got[1].s == 0.75 and got[1].m == 10.0 and got[1].t == "bad"


def test_bins_keep_order(spark):
    values = sorted([random.Random(1).uniform(-1, 1) * 10**k for k in range(-6, 7) for _ in range(50)] + [0.0])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    bins = [r.b for r in df.select("i", value_bin("v").alias("b")).orderBy("i").collect()]
    assert bins == sorted(bins)


@pytest.mark.parametrize("span", [1, 3, 7])
def test_window_quantiles_match_numpy(spark, span):
    rng = random.Random(span)
    # one key holds most rows; many equal values, some negative
    rows = [
        (rng.choice("aaaaaab"), rng.randrange(12), round(rng.lognormvariate(2, 2) - 3, rng.choice([0, 2])))
        for _ in range(3000)
    ] + [("single", 4, 7.5)]
    df = spark.createDataFrame(rows, "service string, pane long, x double")
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = window_rollup(df, ["service"], "x", {"neg": S.flag(F.col("x") < 0)}, probs, span, last=13).collect()
    want = {}
    for key, pane, x in rows:
        for t in range(pane + 1, min(pane + span, 13) + 1):
            want.setdefault((key, t), []).append(x)
    assert {(r.service, r.tick) for r in got} == set(want)
    for r in got:
        xs = want[r.service, r.tick]
        assert r.total == len(xs) and r.neg == sum(x < 0 for x in xs)
        assert r.mean == pytest.approx(np.mean(xs))
        for name, p in probs.items():
            assert r[name] == pytest.approx(replicas.quantile(xs, p), abs=1e-9)


def test_windows_are_spread_after_the_shuffle(spark, capsys):
    df = spark.createDataFrame([("a", 3, 1.0), ("b", 5, 2.0)], "service string, pane long, x double")
    window_rollup(df, ["service"], "x", {"one": F.lit(1)}, {"p95": 0.95}, 30, last=9).explain()
    lines = capsys.readouterr().out.split("== Initial Plan ==")[-1].splitlines()
    spread = [i for i, line in enumerate(lines) if "Generate explode(sequence(" in line and "tick" in line and "chunk" in line]
    spread = [i for i in spread if "AS tick" in lines[i] or "[tick" in lines[i]]
    assert len(spread) == 2  # counts by bin, and sums
    for i in spread:  # the next step up that regroups rows finds them where they are
        above = [line for line in reversed(lines[:i]) if any(w in line for w in ("Exchange", "Window [", "HashAggregate"))]
        assert "Exchange" not in above[0]


def test_long_windows_of_sparse_panes(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(5000), rng.choice([None, 1e15, 0.25, rng.uniform(0, 9)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "service string, pane long, x double")
    got = window_rollup(df, ["service"], "x", {"one": F.lit(1)}, {"p95": 0.95}, 30, last=5000).collect()
    want = {}
    for key, pane, x in rows:
        for t in range(pane + 1, min(pane + 30, 5000) + 1):
            want.setdefault((key, t), []).append(x)
    whole = {k: v for k, v in want.items() if k[0] and None not in v}
    found = {(r.service, r.tick): r for r in got}
    assert len(found) == len(got) and whole.keys() <= found.keys() <= want.keys()
    for k, xs in whole.items():
        r = found[k]
        assert r.total == r.one == len(xs)
        # small values beside large ones that have left the window
        assert r["mean"] == pytest.approx(np.mean(xs), rel=1e-12) and r.p95 == pytest.approx(replicas.quantile(xs, 0.95), rel=1e-12)


def test_callers_of_events(spark, tmp_path, capsys):
    rows = [(e, u, "error", 1.0, "{}") for e in (3, 4, 5, -1) for u in range(14)]
    table = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    table.withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "events"))
    logs = event_logs(spark.read.parquet(str(tmp_path / "events")))
    got = {(int(r.span_id[1:]), r.service): r.parent_service for r in logs.collect()}
    fixed = {
        "auth": "gateway", "search": "gateway", "recommendations": "catalog", "cart": "checkout", "payments": "checkout",
        "ledger": "payments", "notifications": "fulfillment",
    }
    by_third = {
        "sessions": ["cart", "auth", "auth"], "catalog": ["cart", "search", "gateway"], "inventory": ["checkout", "fulfillment", "catalog"]
    }
    for (event, service), parent in got.items():
        k = event % 3 if event >= 0 else 2
        assert parent == (by_third[service][k] if service in by_third else fixed.get(service))
    assert len(got) == 4 * 14
    edge_ticks(logs, Params()).explain()  # its filter looks a service up a few times, not for each comparison
    assert capsys.readouterr().out.count("element_at(") < 20


def test_numbering_and_chains(spark):
    rng = random.Random(5)
    at = sorted({round(rng.uniform(0, 500000), 1) for _ in range(400)} | {1000.0, 1025.0, 1050.1})
    df = spark.createDataFrame([(t,) for t in at], "ts double").repartition(7)
    got = number_rows(df, "ts", [], "n", 1000.0).orderBy("ts").collect()
    assert [r.n for r in got] == list(range(1, len(at) + 1))
    for gap in (25.0, 2000.0):
        starts, start = {}, None
        for before, t in zip([None, *at], at):
            start = t if before is None or t - before > gap else start
            starts[t] = start
        got = chain_by_gap(df, "ts", gap, "chain").collect()
        assert {r.ts: r.chain for r in got} == starts


def test_lookup_with_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), "id"
    )
    found = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.length("k"))
    found = found.filter("k <> 'k7'")
    got = lookup(rows, found, "k", ["v"])
    assert got.count() == 3000
    assert got.filter("v IS NULL").select("k").distinct().collect()[0].k == "k7"
    assert got.filter("v IS NOT NULL AND v <> length(k)").count() == 0
