"""Reading, writing and trimming the log table."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalgraph.schema import LOG_COLUMNS, LOG_SCHEMA

STORED_SCHEMA = T.StructType(
    [*LOG_SCHEMA.fields, T.StructField("event_date", T.DateType()), T.StructField("batch", T.StringType())]
)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The stored table: parquet, a folder per ``event_date`` and written batch."""
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def read_log_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Files landing in ``path`` as a stream. Start one query per consumer: each
    keeps its own checkpoint and so sees every record."""
    reader = spark.readStream.schema(LOG_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """JSON log records from a Kafka topic; needs the Kafka connector jar."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return parse_json_logs(reader.load())


def parse_json_logs(raw: DataFrame) -> DataFrame:
    """Log records from a ``value`` column of JSON texts; broken ones are dropped."""
    record = F.from_json(F.col("value").cast("string"), LOG_SCHEMA)
    return raw.select(record.alias("r")).filter("r.ts IS NOT NULL").select("r.*")


def with_event_date(logs: DataFrame) -> DataFrame:
    """Adds the day in UTC, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(F.col("ts") / 86400.0).cast("int"))
    return logs.select(*LOG_COLUMNS, day.alias("event_date"))


def append_logs(logs: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds a batch; writing the same batch again replaces it, so a retried
    micro-batch is stored once.

    Partitions follow the days but are evened out by size, however much a day or
    service holds. Files are sorted by service and time, so row-group statistics
    on both columns can skip data.
    """
    (
        with_event_date(logs)
        .withColumn("batch", F.lit(batch or uuid.uuid4().hex))
        .hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "service", "ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .partitionBy("event_date", "batch")
        .parquet(path)
    )


def compact_day(spark: SparkSession, path: str, day: str) -> int:
    """Merges the batches of a day that no writer adds to any more into one, evened out
    by size; gives how many it replaced.

    The merged rows are written beside the table first, then a list of the folders they
    replace, then the new folder is moved in and the old ones go. A run that was broken
    off is finished by the next: without a list it starts again, with one it goes on.
    """
    jvm, root = spark.sparkContext._jvm, f"{path}/event_date={day}"
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    work, listed = f"{path}/_compacting/{day}", f"{path}/_compacting/{day}.replaced"
    if not fs.exists(at(listed)):
        names = sorted(f.getPath().getName() for f in fs.listStatus(at(root))) if fs.exists(at(root)) else []
        names = [n for n in names if n.startswith("batch=")]
        if len(names) < 2:
            return 0
        rows = read_logs(spark, path).filter(F.col("event_date") == F.lit(day).cast("date"))
        merged = rows.select(*LOG_COLUMNS).hint("rebalance").sortWithinPartitions("service", "ts")
        merged.write.mode("overwrite").option("parquet.bloom.filter.enabled#trace_id", "true").parquet(work)
        spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").text(listed)
    names = [r.value for r in spark.read.text(listed).collect()]  # folder names of one day
    if fs.exists(at(work)):
        fs.rename(at(work), at(f"{root}/batch=compacted-{uuid.uuid4().hex}"))
    for name in names:
        fs.delete(at(f"{root}/{name}"), True)
    fs.delete(at(listed), True)
    spark.catalog.refreshByPath(path)
    return len(names)


def last_ts(logs: DataFrame) -> float:
    """Newest ``ts``; the default moment of every read. 0.0 for an empty table."""
    return _extreme(logs, F.max)


def first_ts(logs: DataFrame) -> float:
    return _extreme(logs, F.min)


def _extreme(logs: DataFrame, pick) -> float:
    """Looks at one column, and in a table stored by day at one day only."""
    if "event_date" in logs.columns:
        day = logs.agg(pick("event_date")).first()[0]
        logs = logs.filter(F.col("event_date") == F.lit(day))
    return logs.agg(pick("ts")).first()[0] or 0.0


def _bounded(logs: DataFrame, moment_s: float, newer: bool) -> DataFrame:
    """A copy of a bound on ``ts`` for stored time columns, a second looser: it
    prunes partitions and row groups before ``ts`` is computed."""
    moment = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=moment_s + (-1.0 if newer else 1.0))
    bounds = {
        "event_time": F.lit(moment.isoformat(" ")).cast("timestamp_ntz"),
        "event_date": F.lit(moment.date().isoformat()).cast("date"),
    }
    for column, bound in bounds.items():
        if column in logs.columns:
            logs = logs.filter(F.col(column) >= bound if newer else F.col(column) <= bound)
    return logs


def since(logs: DataFrame, cutoff: float) -> DataFrame:
    """Rows with ``ts >= cutoff``."""
    return _bounded(logs.filter(F.col("ts") >= F.lit(cutoff)), cutoff, newer=True)


def until(logs: DataFrame, as_of: float) -> DataFrame:
    """Rows with ``ts <= as_of``."""
    return _bounded(logs.filter(F.col("ts") <= F.lit(as_of)), as_of, newer=False)


def within(logs: DataFrame, as_of: float, seconds: float) -> DataFrame:
    """Rows of the ``seconds`` up to and including ``as_of``."""
    return until(since(logs, as_of - seconds), as_of)


def retained(logs: DataFrame, as_of: float, keep_s: float) -> DataFrame:
    return since(logs, as_of - keep_s)


def prune_logs(spark: SparkSession, path: str, as_of: float, keep_s: float) -> int:
    """Deletes stored rows older than ``as_of - keep_s``; gives how many.

    Folders that hold only older rows are dropped, those cut through are
    rewritten by a dynamic partition overwrite; all others are left alone.
    """
    cutoff = as_of - keep_s
    logs = read_logs(spark, path)
    day = (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=cutoff)).date()
    old = logs.filter(F.col("event_date") <= F.lit(day.isoformat()).cast("date"))
    folders = old.groupBy("event_date", "batch").agg(
        F.sum(F.when(F.col("ts") < cutoff, 1).otherwise(0)).alias("stale"), F.count(F.lit(1)).alias("n")
    )
    touched = folders.filter("stale > 0").collect()  # folder names only
    cut = [r for r in touched if r.stale < r.n]
    if cut:
        names = spark.createDataFrame([(r.event_date, r.batch) for r in cut], "event_date date, batch string")
        kept = old.join(F.broadcast(names), ["event_date", "batch"], "left_semi").filter(F.col("ts") >= cutoff)
        (
            kept.select(*STORED_SCHEMA.fieldNames())
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("event_date", "batch")
            .parquet(path)
        )
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in touched:
        if r.stale == r.n:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"event_date={r.event_date}/batch={r.batch}"), True)
    spark.catalog.refreshByPath(path)
    return sum(r.stale for r in touched)
