"""Pearson correlation of the services' problem rates over the window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLAT = 1e-9  # a series deviating less than this is constant


def correlation(rates: DataFrame, start: int, end: int) -> DataFrame:
    """``rates`` has service, bucket, rate; absent buckets of ``[start, end)`` are 0.

    Gives service_a, service_b, corr for every ordered pair. Products are summed over
    buckets where both services have a rate, for half of the pairs, and mirrored; the
    list of all pairs is the result. A constant series correlates 0 with others, 1
    with itself, as does any over fewer than three buckets.
    """
    n = end - start
    moments = rates.groupBy("service").agg((F.sum("rate") / n).alias("mean"), F.count(F.lit(1)).alias("present"))
    off = F.col("rate") - F.col("mean")
    axis = (
        rates.join(moments, "service")
        .groupBy("service")
        .agg(
            F.max("mean").alias("mean"),
            F.sqrt((F.sum(off * off) + (n - F.max("present")) * F.max("mean") * F.max("mean")) / n).alias("sd"),
        )
        .withColumn("moves", (F.col("sd") >= FLAT) & F.lit(n >= 3))
    )
    some = rates.filter("rate <> 0")
    a, b = (some.select(F.col("service").alias(f"service_{x}"), "bucket", F.col("rate").alias(f"rate_{x}")) for x in "ab")
    half = (
        a.join(b, "bucket")
        .filter("service_a < service_b")
        .groupBy("service_a", "service_b")
        .agg(F.sum(F.col("rate_a") * F.col("rate_b")).alias("products"))
    )
    other = half.select(F.col("service_b").alias("service_a"), F.col("service_a").alias("service_b"), "products")
    left, right = (axis.select(*[F.col(c).alias(f"{c}_{x}") for c in axis.columns]) for x in "ab")
    covariance = F.coalesce("products", F.lit(0.0)) / n - F.col("mean_a") * F.col("mean_b")
    found = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), covariance / (F.col("sd_a") * F.col("sd_b"))))
    return (
        left.crossJoin(right)  # the matrix itself
        .join(half.unionByName(other), ["service_a", "service_b"], "left")
        .select(
            "service_a",
            "service_b",
            F.when(F.col("service_a") == F.col("service_b"), 1.0)
            .when(F.col("moves_a") & F.col("moves_b"), found)
            .otherwise(0.0)
            .alias("corr"),
        )
    )
