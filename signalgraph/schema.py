"""The log record: the one base table every operator reads."""

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.DoubleType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("trace_id", T.StringType(), False),
        T.StructField("span_id", T.StringType(), False),
        T.StructField("parent_service", T.StringType(), True),
        T.StructField("latency_ms", T.DoubleType(), False),
        T.StructField("status_code", T.IntegerType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("template_id", T.LongType(), True),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# fixed values
LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
ERROR_LEVELS = ["ERROR", "FATAL"]
PROBLEM_LEVELS = ["ERROR", "FATAL", "WARN"]
LEVEL_STATUS = {"DEBUG": 200, "INFO": 200, "WARN": 206, "ERROR": 500, "FATAL": 503}

# fixed values: display group of each known service
SERVICE_GROUPS = {
    "gateway": "edge",
    "auth": "edge",
    "sessions": "core",
    "catalog": "core",
    "search": "edge",
    "cart": "core",
    "checkout": "commerce",
    "payments": "commerce",
    "ledger": "commerce",
    "inventory": "core",
    "recommendations": "core",
    "fulfillment": "commerce",
    "notifications": "delivery",
    "analytics": "delivery",
}
