import random

import pytest
from pyspark.sql import functions as F

import replicas
from signalgraph import Params
from signalgraph.operators import graph as G
from signalgraph.operators import rates as R
from signalgraph.operators import rules as U
from signalgraph.sources import logs as L
from signalgraph.streaming import jobs as J
from signalgraph.streaming import state as ST

P = Params()


@pytest.fixture(scope="module")
def story(spark, make_logs, tmp_path_factory):
    """Logs as five files in time order, and the same as one frame."""
    rng = random.Random(21)
    rows = sorted(rng.uniform(1000, 1200) for _ in range(1500))
    logs = make_logs(
        [
            {
                "ts": round(t, 3),
                "service": rng.choice("aab"),
                "parent_service": rng.choice([None, "a", "b"]),
                "level": rng.choice(["INFO", "ERROR", "WARN"]),
                "latency_ms": round(rng.uniform(1, 500), 1),
                "message": " ".join(rng.choice("pqr") for _ in range(rng.randrange(1, 6))),
            }
            for t in rows
        ]
    ).cache()
    folder = str(tmp_path_factory.mktemp("stream"))
    for i in range(5):
        part = logs.filter((F.col("ts") >= 1000 + i * 40) & (F.col("ts") < 1040 + i * 40))
        part.coalesce(1).write.mode("append").parquet(folder)
    return logs, folder


def stream(spark, folder):
    return L.read_log_stream(spark, folder, max_files=1)


def close(rows, *keys):
    return {tuple(r[k] for k in keys): {k: round(v, 6) for k, v in r.asDict().items() if isinstance(v, float)} for r in rows}


def test_exact_rates_from_streamed_cells(spark, story):
    logs, folder = story
    got = close(J.rates_from_cells(J.run_once(J.pane_cells(stream(spark, folder), P), "t"), P).collect(), "tick_no", "service")
    want = close(R.service_ticks(logs, P).collect(), "tick_no", "service")
    closed = max(k[0] for k in got)
    assert closed >= (1200 - J.LATE_S) // P.tick_s - 2
    assert got == {k: v for k, v in want.items() if k[0] <= closed}


def test_signals_follow_the_batch_ones(spark, story):
    logs, folder = story
    got = close(J.run_once(J.service_signals(J.sliding_rates(stream(spark, folder), P), P), "t").collect(), "tick_no", "service")
    ticks = R.service_ticks(logs, P, ("p95",))
    z = close(R.zscores(ticks, P).collect(), "tick_no", "service")
    from signalgraph.operators.forecast import forecast

    f = close(forecast(ticks, P).collect(), "tick_no", "service")
    assert len(got) > 100
    for k, v in got.items():
        assert v["z_total"] == pytest.approx(z[k]["z_total"], abs=1e-5)
        assert v["z_errors"] == pytest.approx(z[k]["z_errors"], abs=1e-5)
        assert v["z_p95"] == pytest.approx(z[k]["z_p95"], abs=1e-5)
        assert v["forecast"] == pytest.approx(f[k]["forecast"], abs=1e-5)
        assert v["stddev"] == pytest.approx(f[k]["stddev"], abs=1e-5)


def test_sliding_rates_gather_a_row_once(spark, make_logs, tmp_path):
    """Windows are those of the batch; no state holds a row for each window that a log is in."""
    rng = random.Random(22)
    rows = [{"ts": 1000 + i / 10, "service": rng.choice("aab"), "latency_ms": rng.uniform(1, 500)} for i in range(1200)]
    logs = make_logs(rows)
    logs.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    logs.filter("ts > 1119").withColumn("ts", F.col("ts") + 500).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    J.use_rocksdb(spark)
    both = spark.readStream.schema(logs.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = (
        J.sliding_rates(both, P).writeStream.format("memory").queryName("gathered").outputMode("append")
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    held = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    assert held <= 2 * (1200 / 10 / P.tick_s + 30) * 3
    got = {(r.tick_no, r.service): (r.total, r.p95, r.mean_lat) for r in spark.table("gathered").filter("tick <= 1120").collect()}
    want = {(r.tick_no, r.service): (r.total, r.p95, r.mean_lat) for r in R.service_ticks(logs, P).collect()}
    assert len(want) > 100
    for k, (total, p95, mean) in want.items():
        assert got[k] == (total, pytest.approx(p95, abs=1e-6), pytest.approx(mean, abs=1e-6))


def test_bucket_counts(spark, story):
    logs, folder = story
    got = {r.start_us // 1000000: r.total for r in J.run_once(J.second_counts(stream(spark, folder), P), "t").collect()}
    want = {r.b: r.n for r in logs.groupBy(F.floor("ts").alias("b")).agg(F.count("*").alias("n")).collect()}
    assert len(got) > 150 and all(want[k] == n for k, n in got.items())


def test_live_rules(spark, story):
    logs, folder = story
    rules = [("r", 1, "errors", "*", "error_rate", ">", 0.38, 4.0, True)]
    got = J.run_once(J.live_rule_firings(J.sliding_rates(stream(spark, folder), P), P, rules), "t").collect()
    ticks = R.service_ticks(logs, P, ("p95",))
    want = U.rule_firings(U.rule_dwell(U.rule_matches(ticks, U.rules_frame(spark, rules), P), R.tick_numbers(logs, P))).collect()
    closed = (1200 - J.LATE_S) // P.tick_s
    key = lambda r: (r.tick_no, r.service, r.fired_count, round(r.severity, 6))
    assert sorted(map(key, got)) == sorted(key(r) for r in want if r.tick_no <= closed)
    assert got


def test_edge_signals(spark, story):
    logs, folder = story
    got = close(J.run_once(J.edge_signals(stream(spark, folder), P), "t").collect(), "source", "target", "tick_no")
    want = close(G.edge_weights(G.edge_ticks(logs, P), R.tick_numbers(logs, P), P).collect(), "source", "target", "tick_no")
    assert len(got) > 100
    assert all(want[k]["weight"] == v["weight"] for k, v in got.items())


@pytest.mark.parametrize("children", [2, 100])
def test_template_signals(spark, story, children):
    logs, folder = story
    p = Params(template_children=children, template_depth=2)
    got = J.run_once(J.template_signals(stream(spark, folder), p), "t").orderBy("ts", "span_id").collect()
    in_order = logs.orderBy("ts", "span_id").collect()
    want, texts = replicas.mine([r.message for r in in_order], p.template_similarity, 2, children)
    pairs = {(r.template_id, w) for r, w in zip(got, want)}
    assert len(got) == len(in_order)
    assert len(pairs) == len(texts) == len({a for a, _ in pairs})
    assert sum(r.is_new for r in got) == len(texts)


def test_incident_signals(spark, tmp_path):
    rng = random.Random(5)
    near = {"a": ["a", "b"], "b": ["b"], "x": ["x", "y"], "y": ["y"]}
    rows, ts = [], 0.0
    for n in range(200):
        ts += rng.choice([0, 2, 10, 24, 26])
        s = rng.choice(list(near))
        rows.append((f"a{n:04d}", ts, s, near[s], "prod", 0, float(n), s, 0))
    schema = (
        "anomaly_id string, tick double, service string, blast_radius array<string>, env string, "
        "detector_ord int, ord_1 double, ord_2 string, ord_3 int"
    )
    for i in range(2):
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.anomaly_id: r.first_id for r in J.run_once(J.incident_signals(source, P), "t").collect()}
    assert got == replicas.incidents([(a, t, s, b) for a, t, s, b, *_ in rows], P.correlation_gap_s)


def test_append_and_prune(spark, story, tmp_path):
    logs, folder = story
    path, checkpoint = str(tmp_path / "logs"), str(tmp_path / "cp")
    query = J.start_append(stream(spark, folder), path, checkpoint, every="0 seconds")
    query.processAllAvailable()
    query.stop()
    assert L.read_logs(spark, path).count() == logs.count()
    L.append_logs(logs.withColumn("ts", F.col("ts") + 3 * 86400), path)
    assert L.read_logs(spark, path).count() == 2 * logs.count()
    assert len([r for r in L.read_logs(spark, path).select("event_date").distinct().collect()]) == 2
    # the cutoff lies inside the second day, then beyond it
    removed = L.prune_logs(spark, path, as_of=3 * 86400 + 1200.0, keep_s=100.0)
    left = L.read_logs(spark, path)
    want = logs.filter("ts >= 1100").count()
    assert left.count() == want and removed == 2 * logs.count() - want
    assert left.agg(F.min("ts")).first()[0] >= 3 * 86400 + 1100
    assert L.prune_logs(spark, path, as_of=3 * 86400 + 1200.0, keep_s=100.0) == 0
    L.append_logs(logs.limit(0), path)
    assert L.read_logs(spark, path).count() == want


def test_compaction(spark, story, tmp_path):
    logs, _ = story
    path = str(tmp_path / "logs")
    for k in range(4):
        L.append_logs(logs.filter(F.col("ts") % 4 < 1 + k).filter(F.col("ts") % 4 >= k), path, f"b{k}")
    before = sorted(tuple(r) for r in L.read_logs(spark, path).select("ts", "span_id", "service").collect())
    assert L.compact_day(spark, path, "1970-01-01") == 4
    table = L.read_logs(spark, path)
    assert sorted(tuple(r) for r in table.select("ts", "span_id", "service").collect()) == before
    assert table.select("batch").distinct().count() == 1
    assert L.compact_day(spark, path, "1970-01-01") == 0 and L.compact_day(spark, path, "1999-01-01") == 0
    # broken off after the list was written: the rows are not merged a second time
    L.append_logs(logs.limit(5).withColumn("span_id", F.lit("new")), path, "late")
    old = [r.batch for r in table.select("batch").distinct().collect()]
    merged = L.read_logs(spark, path).select(*L.LOG_COLUMNS)
    merged.write.parquet(f"{path}/_compacting/1970-01-01")
    spark.createDataFrame([(f"batch={b}",) for b in [*old, "late"]], "name string").write.text(f"{path}/_compacting/1970-01-01.replaced")
    assert L.compact_day(spark, path, "1970-01-01") == 2
    assert L.read_logs(spark, path).count() == len(before) + 5


def test_json_records(spark):
    good = '{"ts": 1.5, "service": "a", "level": "INFO", "trace_id": "t", "span_id": "s", "message": "hi", "status_code": 200}'
    got = L.parse_json_logs(spark.createDataFrame([(good,), ("{broken",)], "value string")).collect()
    assert [(r.ts, r.service, r.parent_service) for r in got] == [(1.5, "a", None)]


def test_processors_take_several_chunks():
    import pandas as pd

    p = ST.EdgeDecay(P)

    class Kept:
        body = None

        def exists(self):
            return self.body is not None

        def get(self):
            return self.body

        def update(self, value):
            self.body = value

    p.kept = Kept()
    chunk = lambda *t: pd.DataFrame({"source": "a", "target": "b", "tick_no": t, "calls": 1})
    out = pd.concat(p.handleInputRows(("a", "b"), iter([chunk(3, 1), chunk(2)]), None))
    assert list(out.tick_no) == [1, 2, 3] and list(out.weight) == pytest.approx([1, 1.92, 2.7664])
