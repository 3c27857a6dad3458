"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles.
Two texts are linked if their fingerprints differ in at most ``radius`` bits.

Covering (Pagh, 2016): each of the 64 bits gets a nonzero vector of ``radius + 1``
bits; table v (one for each nonzero v) compares the bits whose vector has an odd
product with v. Any ``radius`` differing bits leave some v orthogonal to all their
vectors, so the two fingerprints agree in that table: no pair within the radius is
missed, by construction and not by chance.

Only distinct fingerprints enter the tables, so exact copies cost nothing. Rows of a
table key are dealt to cells of at most about ``2 * cell_rows`` fingerprints: a key
with more becomes a grid of cells in which every two of its fingerprints meet. A cell
emits a star for each of its components, never its pairs.

Null and wordless texts have fingerprint zero and are linked like any other; very
long texts are read whole; a text of fewer words than a shingle is one shingle. A row
with a null ``doc_id`` links like others but is never the smallest of its component,
whose id is null only if it has no other rows. Repeated rows come back each. Columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C
from signalgraph.llm import tokens as K
from signalgraph.llm.components import connected_components

BITS = 64


@dataclass(frozen=True)
class SimhashParams:
    shingle: int = 4
    seed: int = 42
    radius: int = 4
    cell_rows: int = 20_000


def shingle_hashes(text: bytes, width: int, seed: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[width:])]


def fingerprint(hashes: list[int]) -> int:
    """As a signed 64-bit integer."""
    ones = np.zeros(BITS, np.int64)
    h = np.array(hashes, "<u8")
    for k in range(0, len(h), 1 << 16):
        some = h[k : k + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, p: SimhashParams = SimhashParams()) -> DataFrame:
    """doc_id, fp."""
    width, seed = p.shingle, p.seed

    def run(batches: Iterator[pa.RecordBatch]):
        for part in C.slices(batches, "text"):
            found = [fingerprint(shingle_hashes(t or b"", width, seed)) for t in C.blobs(part.column("text"))]
            yield {"doc_id": part.column("doc_id"), "fp": found}

    return C.arrow_map(K.texts_of(docs), run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Signed 64-bit masks, one for each nonzero vector."""
    size = 1 << (radius + 1)
    vector = [i % (size - 1) + 1 for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, size)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def stars(values: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links from each value to the first of its component, under links of at most
    ``radius`` bits. Work falls with what a search has already reached."""
    left, roots, rest = [], [], values
    while len(rest):
        root, rest = rest[0], rest[1:]
        wave = rest[:0]
        front = np.array([root], dtype=values.dtype)
        while len(front) and len(rest):
            some, front = front[:64], front[64:]
            near = (np.bitwise_count(some[:, None] ^ rest[None, :]) <= radius).any(axis=0)
            wave, rest = rest[near], rest[~near]
            left.extend(wave.tolist())
            roots.extend([int(root)] * len(wave))
            front = np.concatenate([front, wave])
    return left, roots


def near_links(fps: DataFrame, p: SimhashParams = SimhashParams()) -> DataFrame:
    """a, b: links that join exactly the fingerprints (column ``fp``, distinct) within
    the radius of each other, directly or over others."""
    radius, most = p.radius, p.cell_rows
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(radius))]
    rows = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")
    counts = rows.groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / most).cast("int").alias("n"))
    shared = C.settle(counts, "shared_keys")  # a join of two plain tables can be split at a hot key
    dealt = (
        rows.join(shared, "key")
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp")
    )
    cells = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")

    def solve(batches: Iterator[pa.RecordBatch]):
        def runs(cell, fp, ends):
            a, b = [], []
            starts = np.concatenate(([0], ends[:-1]))
            size = ends - starts
            two = starts[size == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            a.extend(fp[two[near]].view(np.int64).tolist())
            b.extend(fp[two[near] + 1].view(np.int64).tolist())
            for s, n in zip(starts[size > 2], size[size > 2]):
                x, y = stars(fp[s : s + n], radius)
                a.extend(np.array(x, np.uint64).view(np.int64).tolist())
                b.extend(np.array(y, np.uint64).view(np.int64).tolist())
            return {"a": a, "b": b}

        cell = np.empty((0, 3), np.int64)
        fp = np.empty(0, np.uint64)
        for batch in batches:
            more = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "lo", "hi")], axis=1)
            cell = np.concatenate([cell, more])
            fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            ends = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            if len(ends):
                yield runs(cell[: ends[-1]], fp[: ends[-1]], ends)
                cell, fp = cell[ends[-1] :], fp[ends[-1] :]
        if len(fp):
            yield runs(cell, fp, np.array([len(fp)]))

    return C.arrow_map(cells, solve, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: SimhashParams = SimhashParams()) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    fps = C.settle(fingerprints(docs, p), "fingerprints")
    nodes = C.settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct_fingerprints")
    roots = connected_components(near_links(nodes.select("fp"), p))
    of = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = C.settle(of.join(ids, "root").select("fp", "component_id"), "fingerprint_components")
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame, p: SimhashParams = SimhashParams()) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs, p).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, p: SimhashParams = SimhashParams()) -> DataFrame:
    """``docs`` without the documents that are not the first of their component. All
    rows of a ``doc_id`` share its fate; rows without one stay."""
    extra = near_duplicates(docs, p).filter("doc_id != component_id").select("doc_id")
    return C.without(docs, {"doc_id": F.col("doc_id").cast("long")}, extra)
