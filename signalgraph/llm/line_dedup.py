"""Drops lines that an earlier document already holds.

Every text is split at ``\\n``. A line's key is the line without ASCII white space at
its ends and with A-Z in lower case. Keys of at least ``min_chars`` code points found
in at least ``min_docs`` documents lose all their lines except those in the smallest
document that holds them; other lines stay, joined by ``\\n`` in their old order.

Lines are exploded in Arrow batches as 128-bit hashes of their keys. A hash's
documents are counted with combining on the map side; lines meet the few repeated
hashes again in an equi-join that adaptive execution splits where one line is very
common. Texts are shuffled once, beside the positions to drop.

A null or empty text has one empty line and comes back as it was. Rows with equal
``doc_id`` and text count as one document and all come back; a null ``doc_id``
counts as one document after all others. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C
from signalgraph.llm import tokens as K

LAST = 2**63 - 1


@dataclass(frozen=True)
class LineParams:
    min_chars: int = 10
    min_docs: int = 2


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\f\r").lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode()) >= least)


def line_hashes(docs: DataFrame, p: LineParams) -> DataFrame:
    """h1, h2, doc_id, text_h, pos: the lines with a key long enough."""
    least = p.min_chars

    def explode(batches: Iterator[pa.RecordBatch]):
        for part in C.slices(batches, "text"):
            high, low, rows, pos = [], [], [], []
            for r, text in enumerate(C.blobs(part.column("text"))):
                for k, line in enumerate((text or b"").split(b"\n")):
                    key = line_key(line)
                    if long_enough(key, least):
                        h = xxhash.xxh3_128_intdigest(key)
                        high.append(h >> 64)
                        low.append(h & 0xFFFFFFFFFFFFFFFF)
                        rows.append(r)
                        pos.append(k)
            at = pa.array(rows, pa.int32())
            yield {
                "h1": np.array(high, np.uint64).view(np.int64),
                "h2": np.array(low, np.uint64).view(np.int64),
                "doc_id": part.column("doc_id").take(at),
                "text_h": part.column("text_h").take(at),
                "pos": pos,
            }

    return C.arrow_map(docs, explode, "h1 long, h2 long, doc_id long, text_h long, pos int")


def dropped_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """doc_id (null: the largest), text_h and the sorted positions to drop, for each document with any."""
    keyed = K.texts_of(docs).select(
        F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text", F.xxhash64("text").alias("text_h")
    )
    lines = line_hashes(keyed, p)
    seen = lines.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("keeper"),
        (F.min("doc_id") != F.max("doc_id") if p.min_docs == 2 else F.countDistinct("doc_id") >= p.min_docs).alias("repeated"),
    )
    # written first: a join of two plain tables is one that adaptive execution can split at a hot line
    repeated = C.settle(seen.filter("repeated").select("h1", "h2", "keeper"), "repeated_lines")
    extra = lines.join(repeated, ["h1", "h2"]).filter("doc_id != keeper")
    return extra.groupBy("doc_id", "text_h").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def without_lines():
    """Column function of a text and the positions of the lines to leave out (null: none)."""

    @F.arrow_udf("string")
    def keep(text: pa.Array, drop: pa.Array) -> pa.Array:
        if drop.null_count == len(drop):
            return text.cast(pa.string())
        out = text.to_pylist()
        for r, places in enumerate(drop.to_pylist()):
            if places:
                gone = set(places)
                out[r] = "\n".join(x for k, x in enumerate((out[r] or "").split("\n")) if k not in gone)
        return pa.array(out, pa.string())

    return keep


def drop_repeated_lines(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """``docs`` with ``text`` rebuilt, and ``n_lines`` and ``n_dropped`` beside its columns
    in a struct ``line_dedup`` (replacing a column of that name)."""
    carried = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_key"),
        F.xxhash64(F.col("text").cast("string")).alias("_text"),
    )
    drop = dropped_lines(docs, p).select(F.col("doc_id").alias("_key"), F.col("text_h").alias("_text"), "drop")
    both = carried.join(drop.hint("shuffle_hash"), ["_key", "_text"], "left")
    text = F.col("row.text").cast("string")
    kept = without_lines()(text, "drop")
    lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"))), F.lit(0)) + 1
    told = F.struct(
        lines.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped")
    )
    return both.select(
        *[(kept if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c != "line_dedup"], told.alias("line_dedup")
    )


def digest(docs: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_repeated_lines(K.texts_of(docs), p).select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
