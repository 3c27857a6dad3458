"""Best-fit decreasing packing of documents into windows of a fixed number of tokens.

A document longer than a window is first cut into full windows; these need no
partner. What is left of each document goes, longest first, into the open window
with the least room that still takes it. A segment tree over remaining capacities
(0 to the window) finds that window in a dozen steps.

Leftovers are dealt by a hash into groups of about ``group_rows``; each group packs
alone, so a task holds one group, and each group leaves at most a few windows less
than full. Within a group, equal lengths go by document id, then start.

Null texts are empty documents (their end id alone); repeated rows are packed each;
an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C
from signalgraph.llm import tokens as K


@dataclass(frozen=True)
class PackingParams:
    window: int = 4096
    end_id: int = K.END_ID
    vocabulary: str = ""  # path; empty: the public word-level one
    #: Rows that one packing task gets on average.
    group_rows: int = 50_000


class TightestOpen:
    """Open windows by remaining capacity; the smallest capacity that suffices."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.full = bytearray(2 * self.leaves)  # 1: some window below this node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, which: int) -> None:
        self.open[room].append(which)
        node = room + self.leaves
        while node and not self.full[node]:
            self.full[node] = 1
            node >>= 1

    def take(self, room: int) -> tuple[int, int] | None:
        """Room and number of the window with the least room of at least ``room``."""
        node = room + self.leaves
        while not self.full[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.full[2 * node])
        found = node - self.leaves
        which = self.open[found].pop()
        if not self.open[found]:
            self.full[node] = 0
            while node > 1 and not (self.full[node] | self.full[node ^ 1]):
                node >>= 1
                self.full[node] = 0
        return found, which


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length; lengths come longest first."""
    tree, place, offset = TightestOpen(window), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    for i, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        room, which = found if found else (window, used)
        used += not found
        place[i], offset[i] = which, window - room
        if room > n:
            tree.put(room - n, which)
    return place, offset


def pieces(docs: DataFrame, p: PackingParams = PackingParams()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows of each document and
    the rest of it."""
    path, window, end = p.vocabulary or K.vocabulary_path(), p.window, p.end_id

    def cut(batches):
        for doc_ids, arrays in K.encode_batches(batches, path, end):
            doc, start, length, crc, whole = [], [], [], [], []
            for d, ids in zip(doc_ids.to_pylist(), arrays):
                n = len(ids) // 4
                for a in range(0, n, window):
                    b = min(a + window, n)
                    doc.append(d)
                    start.append(a)
                    length.append(b - a)
                    crc.append(K.crc(ids[4 * a : 4 * b]))
                    whole.append(n)
            yield {"doc_id": doc, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": whole}

    return C.arrow_map(K.texts_of(docs), cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(found: DataFrame, p: PackingParams = PackingParams()) -> DataFrame:
    """``pieces`` with sequence_id (gapless from 0) and offset. ``found`` is read twice."""
    window = p.window
    groups = max(1, math.ceil(found.count() / p.group_rows))
    dealt = found.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        place, offset = best_fit(rows.column("length").to_numpy(), window)
        return rows.append_column("local_id", pa.array(place)).append_column("offset", pa.array(offset))

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp int, local_id long, offset long"
    placed = C.settle(dealt.groupBy("grp").applyInArrow(fit, fields), "packed")
    used = placed.groupBy("grp").agg((F.max("local_id") + 1).alias("windows"))
    return placed.join(C.with_offsets(used, "grp", "windows", "first_id"), "grp").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_id") + F.col("local_id")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, p: PackingParams = PackingParams()) -> DataFrame:
    return pack(C.settle(pieces(docs, p), "pieces"), p)


def sequences(packed: DataFrame, docs: DataFrame, p: PackingParams = PackingParams(), pad_id: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to the window: the training rows themselves.
    Document ids must be unique here."""
    path, end, window = p.vocabulary or K.vocabulary_path(), p.end_id, p.window

    def arrays(batches):
        for doc_ids, found in K.encode_batches(batches, path, end):
            yield {"doc_id": doc_ids, "ids": [np.frombuffer(x, "<u4").astype(np.int32).tolist() for x in found]}

    ids = C.arrow_map(K.texts_of(docs), arrays, "doc_id long, ids array<int>")
    parts = packed.join(ids, packed["doc_id"].eqNullSafe(ids["doc_id"])).select(
        "sequence_id", "offset", F.expr("slice(ids, cast(start + 1 as int), cast(length as int))").alias("ids")
    )
    joined = parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
    return joined.withColumn("ids", F.slice(F.concat("ids", F.array_repeat(F.lit(pad_id), window)), 1, window))
