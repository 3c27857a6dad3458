"""The four detectors as anomaly rows, and their union.

Every anomaly has ``detector_ord`` and ``ord_1 .. ord_3``: within a tick,
signals are taken in this order (rates, features, templates, rules).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgraph.functions import scalars as S
from signalgraph.operators.rules import shown_value
from signalgraph.params import Params

ORDER = ["tick", "detector_ord", "ord_1", "ord_2", "ord_3"]
ANOMALY_COLUMNS = [
    "anomaly_id", "tick_no", "tick", "kind", "service", "severity", "description",
    "detector_ord", "ord_1", "ord_2", "ord_3",
]


def _anomalies(df: DataFrame, kind: str, detector_ord: int, severity, description, ords: list[Column]) -> DataFrame:
    out = df.select(
        "tick_no",
        "tick",
        F.lit(kind).alias("kind"),
        "service",
        severity.cast("double").alias("severity"),
        description.alias("description"),
        F.lit(detector_ord).alias("detector_ord"),
        ords[0].cast("double").alias("ord_1"),
        ords[1].cast("string").alias("ord_2"),
        ords[2].cast("int").alias("ord_3"),
    )
    key = ["kind", "tick_no", "ord_1", "ord_2", "ord_3"]
    return out.withColumn("anomaly_id", S.short_id("a_", *key)).select(*ANOMALY_COLUMNS)


def rate_signals(p: Params) -> Column:
    """Error bursts, latency jumps and volume spikes of a row of ``zscores``: sub, z, text."""
    t = p.z_threshold
    signals = [
        (
            (F.col("z_errors") >= t) & (F.col("errors") >= 3),
            F.col("z_errors"),
            F.format_string("error burst: %d errors, z=%.1f", "errors", "z_errors"),
        ),
        (
            (F.col("z_p95") >= t) & (F.col("p95") > 100),
            F.col("z_p95"),
            F.format_string("p95 latency jump to %.0fms, z=%.1f", "p95", "z_p95"),
        ),
        (
            (F.col("z_total") >= t + 1.0) & (F.col("total") > 20),
            F.col("z_total"),
            F.format_string("log volume spike: %d logs, z=%.1f", "total", "z_total"),
        ),
    ]
    each = F.array(
        *[
            F.when(hit, F.struct(F.lit(i).alias("sub"), z.alias("z"), text.alias("text")))
            for i, (hit, z, text) in enumerate(signals)
        ]
    )
    return F.filter(each, lambda s: s.isNotNull())


def rate_anomalies(scored: DataFrame, p: Params) -> DataFrame:
    """``rate_signals`` of ``zscores`` output as anomalies."""
    t = p.z_threshold
    fired = scored.select("tick_no", "tick", "service", "total", F.explode(rate_signals(p)).alias("s"))
    return _anomalies(
        fired,
        "rate_spike",
        0,
        S.z_severity(F.col("s.z"), t),
        F.col("s.text"),
        [-F.col("total"), F.col("service"), F.col("s.sub")],
    )


def feature_anomalies(
    decisions: DataFrame, ticks: DataFrame, min_severity: float = 0.0
) -> DataFrame:
    """Outliers of the isolation forest. Some service is flagged on nearly every
    tick, however calm; ``min_severity`` can hold back the mild ones."""
    hits = decisions.filter("is_outlier").join(ticks.select("tick_no", "service", "total"), ["tick_no", "service"])
    severity = S.outlier_severity("decision")
    text = F.concat(F.lit("multi-feature outlier (iforest score="), S.signed("decision", 2), F.lit(")"))
    return _anomalies(
        hits.filter(severity >= min_severity),
        "feature_outlier",
        1,
        severity,
        text,
        [-F.col("total"), F.col("service"), F.lit(0)],
    )


def template_anomalies(fresh: DataFrame) -> DataFrame:
    """One signal per new template, on the service that first wrote it."""
    text = F.concat(F.lit('new log template: "'), F.substring("first_text", 1, 70), F.lit('"'))
    return _anomalies(
        fresh.filter(F.col("service").isNotNull()),
        "new_template",
        2,
        F.lit(0.6),
        text,
        [F.col("template_id"), F.col("service"), F.lit(0)],
    )


def rule_anomalies(firings: DataFrame) -> DataFrame:
    text = F.concat(F.lit("rule · "), F.col("name"), F.lit(" (observed "), shown_value(), F.lit(")"))
    return _anomalies(
        firings, "rule_fired", 3, F.col("severity"), text, [F.col("position"), F.concat_ws("|", "rule_id", "scope"), F.lit(0)]
    ).withColumn("service", F.col("service"))


def all_anomalies(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_blast_radius(anomalies: DataFrame, tick_topology: DataFrame, blast: DataFrame) -> DataFrame:
    """Adds what each anomaly's service reaches in the graph of its tick; a
    service outside the graph reaches itself only."""
    alone = F.array("service")
    return (
        anomalies.join(tick_topology, "tick_no", "left")
        .join(blast.withColumnRenamed("source", "service"), ["topology", "service"], "left")
        .withColumn("blast_radius", F.coalesce("blast_radius", alone))
        .withColumn("blast_hops", F.coalesce("blast_hops", F.create_map("service", F.lit(0))))
    )


def recent_anomalies(anomalies: DataFrame, limit: int = 30) -> DataFrame:
    """The last anomalies, newest last signal first."""
    return anomalies.orderBy(*[F.col(c).desc() for c in ORDER]).limit(limit)


def anomaly_load(anomalies: DataFrame, numbered: DataFrame, p: Params) -> DataFrame:
    """At each tick, how many anomalies the last ``anomaly_recent_s`` hold.

    Each tick's count is handed to every later tick within reach, so no window
    spans the whole time line.
    """
    ahead = int(p.anomaly_recent_s // p.tick_s)
    per_tick = anomalies.groupBy("tick_no").agg(F.count(F.lit(1)).alias("n"))
    reached = (
        per_tick.withColumn("tick_no", F.explode(F.sequence("tick_no", F.col("tick_no") + ahead)))
        .groupBy("tick_no")
        .agg(F.sum("n").alias("n"))
    )
    return numbered.join(reached, "tick_no", "left").select(
        "tick_no", "tick", F.coalesce("n", F.lit(0)).cast("bigint").alias("anomalies_recent")
    )
