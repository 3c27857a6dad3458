"""Views of other tables as logs, so that every operator can read them.

Each gives the ten log columns. Views of tables with a stored timestamp add it as
``event_time``, so that a time filter can reach the parquet scan; they read it as
UTC, so the session's time zone must be UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalgraph.functions.scalars import status_of
from signalgraph.schema import LOG_COLUMNS

# fixed values: service of user_id modulo 14
EVENT_SERVICES = [
    "gateway", "auth", "sessions", "catalog", "search", "cart", "checkout",
    "payments", "ledger", "inventory", "recommendations", "fulfillment",
    "notifications", "analytics",
]

# fixed values: who calls a service, by event_id modulo 3 (0, 1, other)
EVENT_CALLERS = {
    "auth": ("gateway", "gateway", "gateway"),
    "sessions": ("cart", "auth", "auth"),
    "catalog": ("cart", "search", "gateway"),
    "search": ("gateway", "gateway", "gateway"),
    "cart": ("checkout", "checkout", "checkout"),
    "payments": ("checkout", "checkout", "checkout"),
    "ledger": ("payments", "payments", "payments"),
    "inventory": ("checkout", "fulfillment", "catalog"),
    "recommendations": ("catalog", "catalog", "catalog"),
    "notifications": ("fulfillment", "fulfillment", "fulfillment"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_seconds(stamp: str):
    return F.unix_micros(F.col(stamp).cast("timestamp")) / F.lit(1000000.0)


def event_logs(events: DataFrame) -> DataFrame:
    """One log per event; the service is derived from the user."""
    user = F.col("user_id") % 14
    third = F.col("event_id") % 3
    place = (user + 1).cast("int")
    service = F.element_at(F.array(*[F.lit(s) for s in EVENT_SERVICES]), place)
    level = (
        F.when((F.col("event_type") == "error") & (F.col("value") >= 100), "FATAL")
        .when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "signup", "WARN")
        .when(F.col("event_type") == "view", "DEBUG")
        .otherwise("INFO")
    )
    # a filter on the caller repeats its expression: it is a place in a list, not a chain of comparisons
    nobody = (None, None, None)
    callers = [F.element_at(F.array(*[F.lit(EVENT_CALLERS.get(s, nobody)[k]) for s in EVENT_SERVICES]), place) for k in range(3)]
    parent = F.when(third == 0, callers[0]).when(third == 1, callers[1]).otherwise(callers[2])
    message = F.concat(
        "event_type",
        F.lit(" handled user=u_"),
        F.col("user_id").cast("string"),
        F.lit(" took "),
        F.col("value").cast("decimal(12,2)").cast("string"),
        F.lit("ms props "),
        F.col("props"),
    )
    named = events.select(
        "event_id",
        F.col("ts").alias("event_time"),
        epoch_seconds("ts").alias("ts"),
        service.alias("service"),
        level.alias("level"),
        F.concat(F.lit("t"), F.floor(F.col("event_id") / 10).cast("string")).alias("trace_id"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("span_id"),
        F.col("value").alias("latency_ms"),
        message.alias("message"),
        parent.alias("parent_service"),
    )
    return (
        named.withColumn("status_code", status_of())
        .withColumn("template_id", F.lit(None).cast("bigint"))
        .select(*LOG_COLUMNS, "event_time")
    )


def lineitem_logs(lineitem: DataFrame) -> DataFrame:
    """One log per order line; the previous line of the order is the caller."""
    in_order = Window.partitionBy("trace_id").orderBy("l_linenumber", "span_id", "ts", "level", "latency_ms")
    order = F.col("l_orderkey").cast("string")
    return (
        lineitem.select(
            "l_linenumber",
            F.col("l_shipdate").alias("event_time"),
            (epoch_seconds("l_shipdate") + F.col("l_linenumber") / F.lit(1000.0)).alias("ts"),
            F.concat(F.lit("supp_"), (F.col("l_suppkey") % 14).cast("string")).alias("service"),
            F.when(F.col("l_returnflag") == "R", "ERROR")
            .when(F.col("l_returnflag") == "A", "WARN")
            .otherwise("INFO")
            .alias("level"),
            order.alias("trace_id"),
            F.concat_ws("-", order, "l_linenumber", "l_partkey", "l_suppkey").alias("span_id"),
            F.col("l_quantity").cast("double").alias("latency_ms"),
            F.concat(
                F.lit("line shipped part=p_"),
                F.col("l_partkey").cast("string"),
                F.lit(" flag "),
                "l_returnflag",
                F.lit(" status "),
                "l_linestatus",
            ).alias("message"),
        )
        .withColumn("parent_service", F.lag("service").over(in_order))
        .withColumn("status_code", status_of())
        .withColumn("template_id", F.lit(None).cast("bigint"))
        .select(*LOG_COLUMNS, "event_time")
    )


def document_logs(documents: DataFrame) -> DataFrame:
    """One log per line of text; arrival order is (doc_id, line number)."""
    return documents.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "message")
    ).select(
        F.col("doc_id").cast("double").alias("ts"),
        F.col("source").alias("service"),
        F.lit("INFO").alias("level"),
        F.col("doc_id").cast("string").alias("trace_id"),
        F.format_string("%010d", "line_no").alias("span_id"),
        F.lit(None).cast("string").alias("parent_service"),
        F.lit(0.0).alias("latency_ms"),
        F.lit(200).alias("status_code"),
        "message",
        F.lit(None).cast("bigint").alias("template_id"),
    )


def conversation_logs(conversations: DataFrame) -> DataFrame:
    """One log per turn; a conversation is a trace and a role is a service."""
    turn = F.col("turn").cast("string")
    conv = F.col("conv_id").cast("string")
    return conversations.select(
        F.col("turn").cast("double").alias("ts"),
        F.col("role").alias("service"),
        F.lit("INFO").alias("level"),
        conv.alias("trace_id"),
        F.concat_ws("-", conv, turn).alias("span_id"),
        F.lit(None).cast("string").alias("parent_service"),
        F.lit(0.0).alias("latency_ms"),
        F.lit(200).alias("status_code"),
        F.col("text").alias("message"),
        F.lit(None).cast("bigint").alias("template_id"),
    )
