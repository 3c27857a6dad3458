"""Threshold rules with dwell time: metric, operator, threshold, duration, service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalgraph.functions import scalars as S
from signalgraph.functions.ordered import chain_by_gap
from signalgraph.params import Params

RULE_SCHEMA = (
    "rule_id string, position int, name string, service string, metric string, op string, "
    "threshold double, duration_s double, enabled boolean"
)

# fixed values: id, position, name, service, metric, op, threshold, duration in seconds, enabled
DEFAULT_RULES = [
    ("r_err_any", 1, "Error rate > 8% on any service", "*", "error_rate", ">", 0.08, 4.0, True),
    ("r_pay_p95", 2, "payments p95 > 400ms", "payments", "p95_latency", ">", 400.0, 4.0, True),
    ("r_ntf_flood", 3, "notifications > 500 logs/min", "notifications", "logs_per_min", ">", 500.0, 4.0, True),
]


def rules_frame(spark: SparkSession, rules: list[tuple] = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """Unknown operators never match."""
    return (
        F.when(op == ">", value > threshold)
        .when(op == "<", value < threshold)
        .when(op == ">=", value >= threshold)
        .when(op == "<=", value <= threshold)
        .otherwise(False)
    )


def metric_value(metric: Column, p: Params) -> Column:
    return (
        F.when(metric == "error_rate", F.col("error_rate"))
        .when(metric == "p95_latency", F.col("p95"))
        .when(metric == "logs_per_min", S.per_minute("total", p.window_s))
        .otherwise(F.lit(0.0))
    )


def rules_effective(changes: DataFrame, as_of: float) -> DataFrame:
    """The rule set at ``as_of`` from a change table: ``change_ts``, ``change``
    (add, enable, disable, delete) and, for adds, the rule's columns."""
    past = changes.filter(F.col("change_ts") <= as_of)
    newest = Window.partitionBy("rule_id").orderBy(F.col("change_ts").desc(), F.col("change").desc())
    state = past.withColumn("n", F.row_number().over(newest)).filter("n = 1").select("rule_id", "change")
    added = past.filter("change = 'add'").groupBy("rule_id").agg(
        F.max_by(F.struct("position", "name", "service", "metric", "op", "threshold", "duration_s"), "change_ts").alias("r")
    )
    return (
        added.join(state, "rule_id")
        .filter("change <> 'delete'")
        .select("rule_id", "r.*", (F.col("change") != "disable").alias("enabled"))
    )


def rule_versions(changes: DataFrame) -> DataFrame:
    """Each rule's enabled spans ``[from_ts, to_ts)`` of a change table, with
    ``epoch``, which counts the times its dwell was reset by a change."""
    history = Window.partitionBy("rule_id").orderBy("change_ts", "change")
    resets = F.when(F.col("change") == "enable", 0).otherwise(1)
    body = F.when(
        F.col("change") == "add",
        F.struct("position", "name", "service", "metric", "op", "threshold", "duration_s"),
    )
    spans = changes.select(
        "rule_id",
        "change",
        F.col("change_ts").alias("from_ts"),
        F.lead("change_ts").over(history).alias("to_ts"),
        F.sum(resets).over(history).alias("epoch"),
        F.last(body, ignorenulls=True).over(history).alias("r"),
    )
    return spans.filter(F.col("change").isin("add", "enable")).select("rule_id", "epoch", "from_ts", "to_ts", "r.*")


def rule_matches(
    ticks: DataFrame, rules: DataFrame, p: Params, per_service: bool = False
) -> DataFrame:
    """Per tick and rule the first service that matches, in order of its rows.

    ``rules`` is a rule set, or the ``rule_versions`` of a change table. A rule
    on ``*`` is met by every service: each aggregate row asks for the rules of
    its own service and for those of ``*``, so both are one equi-join.
    """
    asked = ticks.withColumn("asked", F.explode(F.array(F.col("service"), F.lit("*"))))
    r = rules.withColumnRenamed("service", "asked")
    if "enabled" in r.columns:
        r = r.filter("enabled").drop("enabled")
    if "epoch" not in r.columns:
        r = r.withColumns({"epoch": F.lit(0).cast("bigint"), "from_ts": F.lit(None).cast("double"), "to_ts": F.lit(None).cast("double")})
    live = (F.col("from_ts").isNull() | (F.col("tick") >= F.col("from_ts"))) & (
        F.col("to_ts").isNull() | (F.col("tick") < F.col("to_ts"))
    )
    hits = (
        asked.join(r, "asked")
        .filter(live)
        .withColumn("value", metric_value(F.col("metric"), p))
        .filter(compare(F.col("value"), F.col("op"), F.col("threshold")))
    )
    hits = hits.withColumn("scope", F.col("service") if per_service else F.col("asked"))
    in_order = Window.partitionBy("tick", "rule_id", "scope").orderBy(F.col("total").desc(), F.col("service"))
    return (
        hits.withColumn("place", F.row_number().over(in_order))
        .filter("place = 1")
        .select(
            "rule_id", "scope", "epoch", "position", "name", "metric", "duration_s",
            "tick_no", "tick", "service", "total", "value",
        )
    )


def rule_dwell(matches: DataFrame, numbered: DataFrame) -> DataFrame:
    """Adds since when each match has held without a break (``entered_at``).

    ``numbered`` has ``tick_no``, ``tick`` and ``seq``, the running number of ticks that
    hold rows; a run of consecutive numbers is one dwell. Runs are found in slices of
    ``seq``, so a rule's history is not one task.
    """
    keys = ["rule_id", "scope", "epoch"]
    held = chain_by_gap(matches.join(numbered.select("tick_no", "seq"), "tick_no"), "seq", 1.0, "run", keys)
    begun = numbered.select(F.col("seq").alias("run"), F.col("tick").alias("entered_at"))
    return held.join(begun, "run").withColumn("dwell_s", F.col("tick") - F.col("entered_at"))


def rule_firings(dwell: DataFrame) -> DataFrame:
    """One row per dwell that lasted long enough, at its first such tick."""
    keys = ["rule_id", "scope", "epoch", "run"]
    so_far = Window.partitionBy("rule_id", "scope").orderBy("seq")
    rest = [c for c in dwell.columns if c not in (*keys, "seq")]
    return (
        dwell.filter(F.col("dwell_s") >= F.col("duration_s"))
        .groupBy(*keys)
        .agg(F.min(F.struct("seq", *rest)).alias("first"))
        .select(*keys, "first.*")
        .withColumn("fired_count", F.row_number().over(so_far).cast("bigint"))
        .withColumn("severity", S.rule_severity("fired_count"))
        .drop("run", "seq", "epoch")
    )


def shown_value() -> Column:
    return (
        F.when(F.col("metric") == "error_rate", F.format_string("%.1f%%", F.col("value") * 100))
        .when(F.col("metric") == "p95_latency", F.format_string("%.0fms", F.col("value")))
        .otherwise(F.format_string("%.0f/min", F.col("value")))
    )
