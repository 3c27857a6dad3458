"""Near-duplicates by the Jaccard similarity of word shingles.

Two texts are linked if the sets of their five-word shingles have a similarity of at
least ``least``. Texts of one set are one node, so exact copies cost nothing.

Links are found in two steps. Together they leave no pair out: the components are those of all pairs.

The first step joins most. Its candidates come from SimHash and MinHash. A fingerprint is the
bitwise majority of a text's shingle hashes; the masks of ``simhash`` give each two fingerprints
that differ in at most ``radius`` bits a common key, by construction. Texts at 0.8 differ in 10 of
64 bits on average, which would take 2^18 masks, so those beyond the radius share a MinHash key
(Broder, 1997): ``bands`` keys of ``rows`` minima each. Within a key, differing bits, or one byte
of each minimum, tell which texts are near. At each of ``levels`` a search spans the texts that
estimates join, and emits a tree of up to ``links`` links a text, never all pairs.

The second step takes every pair of texts that the first one has not joined, directly or over
others. Shingles have one order for all texts: those whose cell of a count of all shingles is
full come last, hashes decide among the rest. Two texts at ``least`` have a shingle in common among the first
``n - least * n + 1`` of each (prefix filter: Chaudhuri et al., 2006), so texts are brought
together by these shingles. A pair is dropped only if sizes, places of the shingle or odd sketches
bound its similarity below ``least``: each bit in which two odd sketches (parities of the shingles of
a hash class) differ needs a shingle that only one of the texts has. The order decides the time, never the pairs.

The shingle sets of the candidates of both steps are compared exactly, so no link is under ``least``.

Keys with many texts are dealt to grids of cells as in ``simhash``.

Null and wordless texts have the empty set and are one group; very long texts are read
whole; a text of fewer words than a shingle is one shingle. Rows go by ``doc_id`` and
text; a row with a null ``doc_id`` links like others but is never removed, nor the one
that stays if its group has an id. An empty table gives an empty result. Columns other than
``doc_id`` and ``text`` are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C
from signalgraph.llm.components import connected_components
from signalgraph.llm.simhash import BITS, covering_masks, fingerprint, shingle_hashes


@dataclass(frozen=True)
class ShingleParams:
    shingle: int = 5
    least: float = 0.8
    seed: int = 42
    radius: int = 4
    bands: int = 25
    rows: int = 5
    levels: tuple = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6)
    links: int = 4
    cell_rows: int = 2_000
    common: int = 64  # shingles of a cell with more come last in the order, if that is above the usual count
    cells: int = 1 << 22


def shingle_set(text: bytes, p: ShingleParams) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, p.shingle, p.seed), np.uint64))


def draws(p: ShingleParams) -> tuple[np.ndarray, np.ndarray]:
    """Factor and summand of each hash function, as columns."""
    by, plus = np.random.default_rng(p.seed).integers(0, 1 << 64, (2, p.bands * p.rows, 1), np.uint64)
    return by | np.uint64(1), plus


def minima(hashes: np.ndarray, by: np.ndarray, plus: np.ndarray) -> np.ndarray:
    least = np.full(len(by), np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[k : k + 512] * by + plus).min(axis=1))
    return least


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def cell_of(found: np.ndarray, cells: int) -> np.ndarray:
    return (found >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def common_cells(docs: DataFrame, p: ShingleParams) -> np.ndarray:
    """Of each cell of hashes, whether its shingles are common: so many in all texts that the cell is above
    ``common`` and four times the usual. As many bits as ``cells`` come to the driver, whatever the texts."""
    size = p.cells // 64

    def count(batches: Iterator[pa.RecordBatch]):
        counts = None
        for part in C.slices(batches, "text"):
            found = [cell_of(shingle_set(t or b"", p), p.cells) for t in C.blobs(part.column("text"))]
            some = np.bincount(np.concatenate(found), minlength=p.cells)
            counts = some if counts is None else counts + some
        if counts is not None:
            blocks = np.minimum(counts, 255).astype(np.uint8).reshape(64, size)
            yield {"block": range(64), "counts": [b.tobytes() for b in blocks]}

    def add(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
                total[block] = total.get(block, 0) + np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64)
        bits = [np.packbits(t > max(p.common, 4 * t.mean())).tobytes() for t in total.values()]
        yield {"block": list(total), "counts": bits}

    parts = C.arrow_map(docs.select(F.col("text").cast("string").alias("text")), count, "block int, counts binary")
    common = np.zeros(p.cells, bool)
    for block, bits in C.arrow_map(parts.repartition(16, "block"), add, "block int, counts binary").collect():
        common[block * size : (block + 1) * size] = np.unpackbits(np.frombuffer(bits, np.uint8))
    return common


def prefix(found: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The shingles of a sorted set that come first, as many as a similar text must share one of."""
    last = common[cell_of(found, len(common))]
    most = len(found) - math.ceil(least * len(found) - 1e-9) + 1
    return np.concatenate([found[~last], found[last]])[:most]


def odd_sketch(found: np.ndarray) -> bytes:
    """Parities of how many shingles have the same last bits, about a bit for each shingle."""
    bits = max(64, 1 << (max(1, len(found)) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def marks(docs: DataFrame, p: ShingleParams) -> DataFrame:
    """doc_id, text_hash, node (hash of the shingle set), fp (its SimHash fingerprint), keys, sketch;
    size, prefix and odd sketch of the set."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))

    drawn = draws(p)
    common = np.packbits(common_cells(docs, p))

    def run(batches: Iterator[pa.RecordBatch]):
        last = np.unpackbits(common).astype(bool)
        for part in C.slices(batches, "text"):
            node, fp, keys, sketch, size, first, odd = [], [], [], [], [], [], []
            for t in C.blobs(part.column("text")):
                found = shingle_set(t or b"", p)
                low = minima(found, *drawn)
                node.append(xxhash.xxh64_intdigest(found.tobytes()))
                fp.append(fingerprint(found))
                bands = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(low.reshape(p.bands, p.rows))]
                keys.append(np.array(bands, np.uint64).view(np.int64).tolist())
                sketch.append((low >> np.uint64(24)).astype(np.uint8).tobytes())
                size.append(len(found))
                first.append(prefix(found, last, p.least).view(np.int64))
                odd.append(odd_sketch(found))
            yield {
                "doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"),
                "node": np.array(node, np.uint64).view(np.int64), "fp": fp, "keys": keys, "sketch": sketch,
                "size": size, "prefix": first, "odd": odd,
            }

    columns = "doc_id long, text_hash long, node long, fp long, keys array<long>, sketch binary, size long, prefix array<long>, odd binary"
    return C.arrow_map(rows, run, columns)


def tree(sketch: np.ndarray, least: float, most: int) -> tuple[list[int], list[int]]:
    """Rows of ``sketch`` joined to the nearest ``most`` of those that a search had reached
    when it reached them."""
    left, right, rest = [], [], np.arange(len(sketch))
    need = least * sketch.shape[1]
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            some, front = front[:16], front[16:]
            same = np.stack([(sketch[rest] == sketch[i]).sum(axis=1) for i in some])
            near = same.max(axis=0) >= need
            for row, alike in zip(rest[near].tolist(), same[:, near].T):
                for k in np.argsort(-alike, kind="stable")[:most].tolist():
                    if alike[k] >= need:
                        left.append(row)
                        right.append(int(some[k]))
            front, rest = np.concatenate([front, rest[near]]), rest[~near]
    return left, right


def fingerprinted(nodes: DataFrame, p: ShingleParams) -> DataFrame:
    """``nodes`` with the keys of the covering masks, and the fingerprint as sketch."""
    keys = [F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(p.radius))]
    return nodes.select("node", F.array(*keys).alias("keys"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("sketch"))


def candidates(nodes: DataFrame, p: ShingleParams, bits: bool = False) -> DataFrame:
    """a, b: nodes to be compared, from ``nodes`` (node, keys, sketch). With ``bits`` sketches
    are fingerprints, and texts are near within each radius up to ``radius``."""
    levels = [1 - r / BITS for r in range(p.radius + 1)] if bits else p.levels
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    counts = rows.groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / p.cell_rows).cast("int").alias("n"))
    shared = C.settle(counts, "shared_masks" if bits else "shared_bands")
    dealt = (
        rows.join(shared, "key")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node")
    )
    full = dealt.join(nodes.select("node", "sketch"), "node")
    cells = full.select("key", "lo", "hi", "node", "sketch").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def solve(batches: Iterator[pa.RecordBatch]):
        def links(node, sketch):
            pairs = set()
            if len(node) > 1:
                sketch = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(node), -1)
                if bits:
                    sketch = np.unpackbits(sketch, axis=1)
                for level in levels:
                    pairs.update((max(node[i], node[j]), min(node[i], node[j])) for i, j in zip(*tree(sketch, level, p.links)))
            return {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}

        cell, node, sketch = None, [], []
        for batch in batches:
            for key, lo, hi, v, s in zip(*[batch.column(c).to_pylist() for c in ("key", "lo", "hi", "node", "sketch")]):
                if (key, lo, hi) != cell:
                    yield links(node, sketch)
                    cell, node, sketch = (key, lo, hi), [], []
                node.append(v)
                sketch.append(s)
        yield links(node, sketch)

    return C.arrow_map(cells, solve, "a long, b long").distinct()


def shared_shingles(nodes: DataFrame, p: ShingleParams) -> DataFrame:
    """key (a shingle), node, place, n: prefixes without the shingles that one text alone has there; ``n``
    is how many parts the texts of the shingle are dealt to."""
    rows = nodes.select("node", F.posexplode("prefix").alias("place", "key")).select("key", "node", "place")

    def repeated(batches: Iterator[pa.RecordBatch]):
        def groups(key, node, place):
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))
            keep = size > 1
            return {"key": key[keep], "node": node[keep], "place": place[keep], "n": (size[keep] + p.cell_rows - 1) // p.cell_rows}

        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "place")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last shingle may go on
            if cut:
                yield groups(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield groups(*held)

    return C.arrow_map(rows.repartition("key").sortWithinPartitions("key"), repeated, "key long, node long, place int, n int")


def may_be_similar(shared: np.ndarray, both: np.ndarray, least: float) -> np.ndarray:
    """Whether sets with at most ``shared`` common shingles, of sizes that add up to ``both``, can be similar."""
    return shared >= least * (both - shared)


class OddSketches:
    """Odd sketches of rows, as tables of those of one length."""

    def __init__(self, odd: list[bytes], size: np.ndarray) -> None:
        self.size, self.width = size, np.array([len(x) for x in odd])
        self.rank, self.tables = np.zeros(len(odd), np.int64), {}
        for w in np.unique(self.width).tolist():
            of = np.flatnonzero(self.width == w)
            self.rank[of] = np.arange(len(of))
            self.tables[w] = np.frombuffer(b"".join(odd[i] for i in of), np.uint64).reshape(len(of), w // 8)

    def _folded(self, rows: np.ndarray, w: int, to: int) -> np.ndarray:
        words = self.tables[w][self.rank[rows]]
        while w > to:
            words, w = words[:, : w // 16] ^ words[:, w // 16 :], w // 2
        return words

    def near(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Of pairs (a, b) of rows, which are not shown to be too different."""
        out = np.zeros(len(a), bool)
        for u, v in set(zip(self.width[a].tolist(), self.width[b].tolist())):
            of = np.flatnonzero((self.width[a] == u) & (self.width[b] == v))
            step = max(1, (1 << 24) // max(u, v))
            for k in range(0, len(of), step):
                i, j = a[of[k : k + step]], b[of[k : k + step]]
                apart = np.bitwise_count(self._folded(i, u, min(u, v)) ^ self._folded(j, v, min(u, v))).sum(axis=1, dtype=np.int64)
                both = self.size[i] + self.size[j]
                out[of[k : k + step]] = may_be_similar((both - apart) // 2, both, least)
        return out


def remaining(nodes: DataFrame, roots: DataFrame, p: ShingleParams) -> DataFrame:
    """a, b: all pairs of nodes of different ``roots`` (node, root) that may be similar."""
    known = nodes.select("node", "size", "odd").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shared = C.settle(shared_shingles(nodes, p), "shared_shingles")
    dealt = (
        shared.withColumn("part", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "place")
    )
    full = dealt.join(known, "node").select("key", "lo", "hi", "part", "node", "place", "size", "root", "odd")
    cells = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    names = ("key", "lo", "hi", "part", "node", "place", "size", "root")

    def solve(batches: Iterator[pa.RecordBatch]):
        def pairs(columns, odd):
            key, lo, hi, part, node, place, size, root = columns
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
            rows_of = np.diff(np.append(starts, len(key)))
            after = np.repeat(starts + rows_of, rows_of) - np.arange(len(key))  # rows of the cell from here on
            split = np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), rows_of)
            rows, step = np.flatnonzero(split & (after > 1)), 1
            sketches = OddSketches(odd, size)
            asked: list[tuple[np.ndarray, np.ndarray]] = []
            while len(rows):
                a, b = rows, rows + step
                ask = (root[a] != root[b]) & ((lo[a] == hi[a]) | (part[a] != part[b]))
                a, b = a[ask], b[ask]
                most = np.minimum(size[a] - place[a], size[b] - place[b])  # of the first shingle in common
                ask = may_be_similar(most, size[a] + size[b], p.least)
                asked.append((a[ask], b[ask]))
                step += 1
                rows = rows[after[rows] > step]
                if not len(rows) or sum(len(x) for x, _ in asked) > 100_000:
                    a, b = (np.concatenate(x) for x in zip(*asked))
                    near = sketches.near(a, b, p.least)
                    x, y = node[a[near]], node[b[near]]
                    asked = []
                    yield {"a": np.maximum(x, y), "b": np.minimum(x, y)}

        held, odd = None, []
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            odd += batch.column("odd").to_pylist()
            if len(odd) < 20_000:
                continue
            key, lo, hi = held[:3]
            ends = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            if len(ends):
                yield from pairs([x[: ends[-1]] for x in held], odd[: ends[-1]])
                held, odd = [x[ends[-1] :] for x in held], odd[ends[-1] :]
        if odd:
            yield from pairs(held, odd)

    return C.arrow_map(cells, solve, "a long, b long").distinct()


def compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, p: ShingleParams) -> DataFrame:
    """a, b: those of the settled ``pairs`` whose shingle sets are found similar."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "text_hash"), "node")
    texts = docs.select(text_hash().alias("text_hash"), F.col("text").cast("string").alias("text")).join(asked, "text_hash")

    def collect(batches: Iterator[pa.RecordBatch]):
        for part in C.slices(batches, "text", C.SLICE_BYTES // 4):
            found = [shingle_set(t or b"", p).view(np.int64) for t in C.blobs(part.column("text"))]
            yield {"node": part.column("node"), "shingles": found}

    sets = C.settle(C.arrow_map(texts.dropDuplicates(["node"]), collect, "node long, shingles array<long>"), "shingle_sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b"
    )

    def compare(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            near = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared >= p.least * (len(x) + len(y) - shared))
            keep = pa.array(near, pa.bool_())
            yield {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)}

    return C.settle(C.arrow_map(both.select("a", "b", "of_a", "of_b"), compare, "a long, b long"), "similar_links")


def similar_links(docs: DataFrame, nodes: DataFrame, p: ShingleParams) -> DataFrame:
    """a, b: links that join what all pairs of similar sets join."""
    close = candidates(fingerprinted(nodes, p), p, bits=True)
    pairs = C.settle(close.union(candidates(nodes, p)).distinct(), "candidates")
    roots = C.settle(connected_components(compared(docs, nodes, pairs, p)), "first_components")
    rest = compared(docs, nodes, C.settle(remaining(nodes, roots, p), "remaining"), p)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rest)


def near_duplicates(docs: DataFrame, p: ShingleParams = ShingleParams()) -> DataFrame:
    """doc_id, text_hash, component_id for every row."""
    found = C.settle(marks(docs, p), "shingle_marks")
    firsts = found.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash"),
        *[F.first(c).alias(c) for c in ("fp", "keys", "sketch", "size", "prefix", "odd")],
    )
    nodes = C.settle(firsts, "shingle_nodes")
    roots = connected_components(similar_links(docs, nodes, p))
    of = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = C.settle(of.join(ids, "root").select("node", "component_id"), "shingle_components")
    return found.join(known, "node").select("doc_id", "text_hash", "component_id")


def one_of_each(docs: DataFrame, p: ShingleParams = ShingleParams()) -> DataFrame:
    """``docs`` without the rows that are not of the first id of their component."""
    extra = near_duplicates(docs, p).filter("doc_id != component_id").select("doc_id", "text_hash")
    return C.without(docs, {"doc_id": F.col("doc_id").cast("long"), "text_hash": text_hash()}, extra)
