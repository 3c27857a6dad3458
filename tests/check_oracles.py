"""Runs every catalog query next to its SQL and compares the rows.

    python tests/check_oracles.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name):
    """'' if Spark and SQL agree, else what differs."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, folder)
    mine_cols, mine = rows_of(df.columns, df.collect())
    if name not in oracle_sql():
        return mine, None
    found = con.execute(oracle_sql()[name])
    cols, theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if mine_cols != cols:
        return mine, f"columns {mine_cols} / {cols}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        only = sorted(a - b)[:3], sorted(b - a)[:3]
        return mine, f"{len(mine)} / {len(theirs)} rows, e.g. {only}"
    return mine, ""


if __name__ == "__main__":
    from __spark_entry__ import queries

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con = session(), duck(folder)
    for name in names:
        began = time.time()
        try:
            mine, differs = compare(spark, con, folder, name)
            word = "rows only" if differs is None else "DIFFERS " + differs if differs else "same"
        except Exception as e:  # noqa: BLE001
            mine, word = [], f"FAILED {type(e).__name__} {str(e)[:1200]}"
        print(f"{name:28s} {len(mine):7d} {time.time() - began:6.1f}s {word}", flush=True)
