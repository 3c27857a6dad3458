"""Removes byte strings that occur earlier, by a distributed difference-cover suffix sort.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a
smaller document, or before in the same one) goes. Strings are judged on the input.

A suffix array over every byte of a corpus is far larger than the corpus, so bytes
are first gathered into phrases, at places that depend on their content only:

1. Winnowing (Schleimer et al., 2003). A string of ``length`` bytes is named by the
   least hash of the ``gram``-byte grams in it. Consecutive start positions with the
   same least gram are a *run*; equal strings lie at the same place of runs with equal
   grams. Runs whose gram occurs nowhere else hold nothing repeated. Stretches of the
   others are strings over an alphabet of phrases, a phrase being the bytes from one
   run's start to the next one's.
2. Difference cover modulo 3 (Kärkkäinen and Sanders, 2003; distributed: Kulla and
   Sanders, 2007). Suffixes at positions 1 and 2 modulo 3 are the sample: their triples
   of phrases are sorted and named by rank, and the names, as two strings for each
   stretch, are sorted by triples again, which orders samples by nine phrases.
   The others are merged in by their first phrase or two and the rank of the sample
   after these. Any two residues have an offset at which both are samples, so there is
   one sorted order for each pair of residues: (phrase, rank), (phrase, phrase, rank)
   and (rank).
3. Each order is dealt to tasks by sampled ranges of (place, chunk), so a passage of a
   great many chunks takes several tasks. Adjacent suffixes are compared over the bytes
   that their run's strings span, across the borders of tasks as well: the classes at
   both ends of a task are joined to those of the others. In a class of equal neighbours
   all runs but those of the earliest chunk are repeated throughout. Within a chunk equal
   prefixes are one key (the combining before the shuffle).
4. Matches end within phrases. So runs that are the first of their class, where others
   of the same gram differ, are checked start by start: hashes of their strings, each
   against earlier ones. This check is exact and also covers suffixes that agree beyond
   the depth of the sort.

Whole copies of a text are known by a hash of it; only the first of them is searched.

Spark moves the work in two ways. Texts lie in a table bucketed by *chunk* (a range of
document ids with about ``chunk_bytes`` of text, in order), so each pass joins what it
needs to them without moving them. Keys of a pass go, sorted and once for each chunk,
to *parts* of about ``part_keys`` keys, by hash or by sampled range; a part answers
each chunk which of its keys others hold, which an earlier chunk holds, or their ranks.
A passage that a third of all documents share is thus one key for each chunk.

Null texts are empty. Null document ids come last. Of rows with the same id and text
the first is the original. Texts under ``length`` bytes lose nothing. An empty table
gives an empty result. Other columns are carried along by ``drop_repeats`` and ignored
otherwise.
"""

from __future__ import annotations

import bisect
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalgraph.llm import common as C
from signalgraph.llm import tokens as K
from signalgraph.sources.staging import delete, staged_at

LAST = 2**63 - 1
MAIL = "chunk long, kind string, part int, data binary"
#: Chunks whose sampled keys set the borders of ranges, and keys of each.
SAMPLE_CHUNKS, SAMPLE_KEYS = 2_000, 64
#: The sorted orders, one for each two residues modulo 3.
ORDERS = ("01", "02", "12")
#: Numbers set aside for the chunks of a range of ids.
CHUNKS_A_RANGE = 1 << 32


@dataclass(frozen=True)
class SuffixParams:
    length: int = 100
    gram: int = 52
    chunk_bytes: int = 4_000_000
    part_keys: int = 250_000
    block_bytes: int = 1_000_000  # text hashed at a time


# --- texts by chunk ---------------------------------------------------------------


class Bucketed:
    """A table in the shared folder, bucketed by chunk; dropped by ``drop``."""

    def __init__(self, df: DataFrame, buckets: int, name: str):
        self.spark: SparkSession = df.sparkSession
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = staged_at(self.spark, name)
        with C.small_batches(self.spark):
            df.write.bucketBy(buckets, "chunk").option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.read.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        delete(self.spark, self.path)


def chunked_texts(docs: DataFrame, p: SuffixParams) -> tuple[Bucketed, int]:
    """chunk, doc_ids, text_hs (hashes), nths (numbers of equal rows), sizes, text (all
    texts of the chunk in a row); the number of buckets. Chunks are numbered in document
    order: by a range of ids, then within it."""
    spark = docs.sparkSession
    docs = K.texts_of(docs)
    bounds = C.id_bounds(docs, p.chunk_bytes)
    buckets = max(len(bounds) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = p.chunk_bytes

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    ordered = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("place"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = (
        ordered.withColumn("range", range_of("place"))
        .withColumn("text_h", F.xxhash64("text"))
        .repartition(buckets, "range")
        .sortWithinPartitions("range", "place", "text_h")
    )

    def gather(batches: Iterator[pa.RecordBatch]):
        now, sub, last, nth = None, 0, None, 0
        ids, hashes, nths, texts = [], [], [], []
        held = 0

        def row():
            return {
                "chunk": [now * CHUNKS_A_RANGE + sub], "doc_ids": [list(ids)], "text_hs": [list(hashes)], "nths": [list(nths)],
                "sizes": [[len(t) for t in texts]], "text": [b"".join(texts)],
            }

        for batch in C.slices(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in ("range", "doc_id", "text_h")]
            for part, doc_id, text_h, text in zip(*columns, C.blobs(batch.column("text"))):
                if ids and (part != now or held >= most):
                    yield row()
                    sub += 1
                    held = 0
                    for x in (ids, hashes, nths, texts):
                        x.clear()
                if part != now:
                    now, sub = part, 0
                nth = nth + 1 if (doc_id, text_h) == last else 1
                last = doc_id, text_h
                ids.append(doc_id)
                hashes.append(text_h)
                nths.append(nth)
                texts.append(text)
                held += len(text)
        if ids:
            yield row()

    fields = "chunk long, doc_ids array<long>, text_hs array<long>, nths array<int>, sizes array<long>, text binary"
    return Bucketed(C.arrow_map(dealt.select("range", "doc_id", "text_h", "text"), gather, fields), buckets, "texts"), buckets


# --- exchanges of keys --------------------------------------------------------------


def unique_rows(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows of a (n, width) array, the first place of each, and each row's number among them."""
    order = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
    rows = keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return rows[new], order[new], number


def hashed(kind: str, keys: np.ndarray, parts: int) -> Iterator[tuple[str, int, bytes]]:
    """Sorted keys as mail to their parts: equal ranges of the first value, a uniform hash."""
    part = ((keys[:, 0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        if b > a:
            yield kind, int(part[a]), np.ascontiguousarray(keys[a:b]).tobytes()


def ranged(kind: str, keys: np.ndarray, borders: list[tuple], width: int, end: tuple = ()) -> Iterator[tuple[str, int, bytes]]:
    """Keys, sorted by their first ``width`` values, as mail to the parts between borders;
    ``end`` follows each key's values in comparisons with them."""

    def value(i: int) -> tuple:
        return (*keys[i, :width].tolist(), *end)

    a = 0
    while a < len(keys):
        part = bisect.bisect_right(borders, value(a))
        b = len(keys) if part == len(borders) else bisect.bisect_left(range(len(keys)), borders[part], lo=a, key=value)
        yield kind, part, np.ascontiguousarray(keys[a:b]).tobytes()
        a = b


def answered(mail: DataFrame, answer: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, name: str) -> DataFrame:
    """Settled answers to letters of one kind. ``answer`` gets all keys of a part and the
    number of the chunk (in order) each came from, and gives a value for each."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk").combine_chunks()
        parts = [np.frombuffer(b, np.uint64).reshape(-1, width) for b in rows.column("data").to_pylist()]
        size = [len(x) for x in parts]
        values = answer(np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), size))
        out = [v.tobytes() for v in np.split(values, np.cumsum(size)[:-1])]
        pa.default_memory_pool().release_unused()
        return pa.table({"chunk": rows.column("chunk"), "kind": rows.column("kind"), "part": rows.column("part"), "data": pa.array(out, pa.binary())})

    return C.settle(mail.groupBy("kind", "part").applyInArrow(run, MAIL), name)


def _groups(keys: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, then chunk; and where a new key begins in it."""
    order = np.lexsort((who, *keys.T[::-1]))
    rows = keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return order, new


def held_by_others(keys: np.ndarray, who: np.ndarray) -> np.ndarray:
    order, new = _groups(keys, who)
    number = np.cumsum(new) - 1
    out = np.empty(len(keys), np.uint8)
    out[order] = np.bincount(number)[number] > 1
    return out


def held_earlier(keys: np.ndarray, who: np.ndarray) -> np.ndarray:
    order, new = _groups(keys, who)
    out = np.empty(len(keys), np.uint8)
    out[order] = ~new
    return out


def ranks(keys: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Dense ranks, from 0; the last value of a part tells how many there are."""
    order, new = _groups(keys, who)
    out = np.empty(len(keys), np.uint32)
    out[order] = np.cumsum(new) - 1
    return out


def in_order(keys: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes (three values that place them, the hash of their prefix, a run's number) in
    sorted order, by their place alone, then by chunk; where a prefix differs from the one
    before it; and the first chunk of the class of equal neighbours that each is in."""
    order = np.lexsort((chunk, keys[:, 2], keys[:, 1], keys[:, 0]))
    prefix = keys[order, 3]
    new = np.ones(len(order), bool)
    new[1:] = prefix[1:] != prefix[:-1]
    starts = np.flatnonzero(new)
    first = np.repeat(np.minimum.reduceat(chunk[order], starts), np.diff(np.append(starts, len(order))))
    return order, new, first


ORDERED = MAIL + ", prefix long, first long"


def equal_neighbours(mail: DataFrame) -> DataFrame:
    """Settled letters with the numbers of each chunk's runs whose prefix, in the sorted
    order of all parts, lies among equal ones that an earlier chunk begins.

    A class may go on in the next part. The first and the last class of a part are
    therefore told apart, with their first chunk, and joined to those of other parts.
    """

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk").combine_chunks()
        letters = [np.frombuffer(b, np.uint64).reshape(-1, 5) for b in rows.column("data").to_pylist()]
        keys = np.concatenate(letters)
        chunk = np.repeat(rows.column("chunk").to_numpy(), [len(x) for x in letters])
        order, new, first = in_order(keys, chunk)
        starts = np.flatnonzero(new)
        border = np.zeros(len(order), np.int8)
        border[: starts[1] if len(starts) > 1 else len(order)] = 1
        border[starts[-1] :] = 2
        chunk, prefix, run = chunk[order], keys[order, 3].view(np.int64), keys[order, 4].astype("<u4")
        out = []
        for side in (0, 1, 2):
            which = np.flatnonzero((border == side) & ((chunk > first) | (side > 0)))
            which = which[np.argsort(chunk[which], kind="stable")]
            cuts = (np.flatnonzero(np.diff(chunk[which])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(which)]):
                if b > a:
                    i = which[a]
                    out.append((int(chunk[i]), run[which[a:b]].tobytes(), int(prefix[i]) if side else None, int(first[i]) if side else None))
        pa.default_memory_pool().release_unused()
        chunks, data, prefixes, firsts = zip(*out) if out else ((), (), (), ())
        same = {c: pa.array([rows.column(c)[0].as_py()] * len(out), rows.schema.field(c).type) for c in ("kind", "part")}
        return pa.table({
            "chunk": pa.array(chunks, pa.int64()), **same, "data": pa.array(data, pa.binary()),
            "prefix": pa.array(prefixes, pa.int64()), "first": pa.array(firsts, pa.int64()),
        })

    found = C.settle(mail.groupBy("kind", "part").applyInArrow(compare, ORDERED), "ordered")
    columns = ["chunk", "kind", "part", "data"]
    border = found.filter("prefix IS NOT NULL")
    begun = border.groupBy("kind", "prefix").agg(F.min("first").alias("begun"))
    later = border.join(begun, ["kind", "prefix"]).filter("chunk > begun").select(columns)
    repeated = C.settle(found.filter("prefix IS NULL").select(columns).union(later), "repeated")
    C.discard(found)
    return repeated


def chunk_pass(left: DataFrame, mail: DataFrame, fn: Callable[[dict, dict], pa.Table], schema: str) -> DataFrame:
    """``fn(row of left, mail by kind)`` for each chunk; mail of a kind is joined in the
    order of parts. ``left`` is bucketed by chunk and stays where it is."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(one: pa.Table, letters_: pa.Table) -> pa.Table:
        if not one.num_rows:
            return arrow.empty_table()
        row = {c: one.column(c)[0] for c in one.column_names}
        post: dict[str, list[bytes]] = {}
        for m in sorted(letters_.to_pylist(), key=lambda m: (m["kind"], m["part"])):
            post.setdefault(m["kind"], []).append(m["data"])
        return fn(row, {kind: b"".join(data) for kind, data in post.items()}).cast(arrow)

    return left.groupBy("chunk").cogroup(mail.groupBy("chunk")).applyInArrow(run, schema)


def mail_pass(left: DataFrame, mail: DataFrame, fn: Callable[[dict, dict], Iterator[tuple[str, int, bytes]]]) -> DataFrame:
    """As ``chunk_pass``, for functions that give letters."""

    def write(row, post):
        out = list(fn(row, post))
        return pa.table({
            "chunk": pa.array([row["chunk"].as_py()] * len(out), pa.int64()), "kind": pa.array([k for k, _, _ in out], pa.string()),
            "part": pa.array([n for _, n, _ in out], pa.int32()), "data": pa.array([d for _, _, d in out], pa.binary()),
        })

    return chunk_pass(left, mail, write, MAIL)


# --- runs ----------------------------------------------------------------------------


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Rolling:
    """Hashes of all grams of a block: differences of running sums of table values times
    powers of an odd base, modulo 2**64, then mixed."""

    def __init__(self, gram: int, seed: int, longest: int):
        self.gram, self.table = gram, _odd(seed, 256)
        base = int(_odd(seed + 1, 1)[0])
        self.up, self.down = (np.ones(longest + 1, np.uint64) for _ in range(2))
        with np.errstate(over="ignore"):
            np.cumprod(np.full(longest, base, np.uint64), out=self.up[1:])
            np.cumprod(np.full(longest, pow(base, -1, 1 << 64), np.uint64), out=self.down[1:])

    def __call__(self, b: np.ndarray) -> np.ndarray:
        n = len(b) - self.gram + 1
        with np.errstate(over="ignore"):
            total = np.empty(len(b) + 1, np.uint64)
            total[0] = 0
            np.cumsum(self.table[b] * self.down[: len(b)], out=total[1:])
            x = (total[self.gram :] - total[:n]) * self.up[:n]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
        return x


_rollers: dict[tuple, Rolling] = {}


def rolling(gram: int, seed: int, longest: int) -> Rolling:
    key = (gram, seed, longest)
    if key not in _rollers:
        _rollers[key] = Rolling(gram, seed, longest)
    return _rollers[key]


def runs_of(text: np.ndarray, p: SuffixParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and gram hashes of the runs of one document."""
    width = p.length - p.gram + 1
    out = []
    for a in range(0, max(len(text) - p.length + 1, 0), p.block_bytes):
        block = text[a : a + p.block_bytes + p.length - 1]
        g = rolling(p.gram, 17, p.block_bytes + p.length)(block)
        least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)  # of equals, the leftmost
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        n = len(g) - width + 1
        least = np.minimum(least[:n], least[width - span : width - span + n])
        at = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        out.append((at + a, np.diff(np.append(at, n)), g[(least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


class Chunk:
    """A row of texts: bytes, and where its documents begin and end."""

    def __init__(self, row: dict):
        self.raw = memoryview(row["text"].as_buffer())
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.array(row["sizes"].as_py(), np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def long_enough(self, p: SuffixParams) -> np.ndarray:
        return np.flatnonzero(self.sizes >= p.length)

    def text_keys(self, which: np.ndarray) -> np.ndarray:
        found = [xxhash.xxh3_128_intdigest(self.raw[a:b]) for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]
        return np.array([(h >> 64, h & 0xFFFFFFFFFFFFFFFF) for h in found], np.uint64).reshape(-1, 2)

    def copies(self, p: SuffixParams, answers: bytes) -> np.ndarray:
        """Whether each document is a whole copy of an earlier one (long ones only)."""
        which = self.long_enough(p)
        _, first, number = unique_rows(self.text_keys(which))
        out = np.zeros(len(self.sizes), bool)
        out[which] = (np.frombuffer(answers, np.uint8)[number] > 0) | (first[number] != np.arange(len(which)))
        return out

    def runs(self, p: SuffixParams, copies: np.ndarray) -> dict[str, np.ndarray]:
        """doc, at (in the chunk), n, h of all runs of first texts."""
        doc, at, n, h = [], [], [], []
        for d in np.flatnonzero((self.sizes >= p.length) & ~copies).tolist():
            s, size, g = runs_of(self.bytes[self.starts[d] : self.ends[d]], p)
            doc.append(np.full(len(s), d))
            at.append(s + self.starts[d])
            n.append(size)
            h.append(g)
        if not doc:
            return {"doc": np.empty(0, np.int64), "at": np.empty(0, np.int64), "n": np.empty(0, np.int64), "h": np.empty(0, np.uint64)}
        return {"doc": np.concatenate(doc), "at": np.concatenate(at), "n": np.concatenate(n), "h": np.concatenate(h)}


def shared(h: np.ndarray, answers: bytes) -> np.ndarray:
    """Which of a chunk's hashes occur again, here or (by the answers) elsewhere."""
    _, _, number = unique_rows(h.reshape(-1, 1))
    return (np.frombuffer(answers, np.uint8)[number] > 0) | (np.bincount(number)[number] > 1) if len(h) else np.empty(0, bool)


RUN_FIELDS = (("at", "<u4"), ("n", "<u2"), ("h", "<u8"), ("phrase", "<u8"), ("prefix", "<u8"), ("stretch", "<u4"))


RUN_ROW = "chunk long, " + ", ".join(f"{name} binary" for name, _ in RUN_FIELDS)


def pack_runs(chunk: int, columns: dict[str, np.ndarray]) -> pa.Table:
    data = {name: pa.array([columns[name].astype(kind).tobytes()], pa.binary()) for name, kind in RUN_FIELDS}
    return pa.table({"chunk": pa.array([chunk], pa.int64())} | data)


def unpack_runs(row: dict) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(row[name].as_py(), kind) for name, kind in RUN_FIELDS}


def phrases(chunk: Chunk, runs: dict[str, np.ndarray], again: np.ndarray, p: SuffixParams) -> dict[str, np.ndarray]:
    """The runs marked in ``again``, with their phrases, prefixes and stretches."""
    keep = np.flatnonzero(again)
    at, n = runs["at"][keep], runs["n"][keep]
    digest, raw = xxhash.xxh3_64_intdigest, chunk.raw
    begins = np.ones(len(keep), bool)
    if len(keep):
        begins[1:] = (runs["doc"][keep][1:] != runs["doc"][keep][:-1]) | (at[1:] != at[:-1] + n[:-1])
    phrase = np.array([digest(raw[a : a + k]) | 1 for a, k in zip(at.tolist(), n.tolist())], np.uint64)
    prefix = np.array([digest(raw[a : a + k + p.length - 1]) for a, k in zip(at.tolist(), n.tolist())], np.uint64)
    return {"at": at, "n": n, "h": runs["h"][keep], "phrase": phrase, "prefix": prefix, "stretch": np.cumsum(begins) - 1}


# --- difference cover -----------------------------------------------------------------


class Cover:
    """Strings over positive numbers, one after the other, with a string's number at each place."""

    def __init__(self, symbols: np.ndarray, string: np.ndarray):
        self.c = symbols.astype(np.uint64)
        self.string = string
        begins = np.ones(len(string), bool)
        begins[1:] = string[1:] != string[:-1]
        self.place = np.arange(len(string)) - np.maximum.accumulate(np.where(begins, np.arange(len(string)), 0)) if len(string) else string
        self.mod = self.place % 3

    def ahead(self, values: np.ndarray, k: int) -> np.ndarray:
        """The values ``k`` places on in the same string; 0 beyond its end."""
        if not k:
            return values
        out = np.zeros(len(values), np.uint64)
        if len(values) > k:
            same = self.string[k:] == self.string[:-k]
            out[:-k][same] = values[k:][same]
        return out

    def triples(self) -> np.ndarray:
        return np.stack([self.c, self.ahead(self.c, 1), self.ahead(self.c, 2)], 1)

    @property
    def sample(self) -> np.ndarray:
        return np.flatnonzero(self.mod > 0)

    def names(self, names: np.ndarray) -> tuple[Cover, np.ndarray]:
        """The two strings of sample names of every string, and their places here."""
        at = self.sample
        order = np.lexsort((self.place[at], self.mod[at], self.string[at]))
        return Cover(names[order] + 1, self.string[at][order].astype(np.int64) * 2 + self.mod[at][order] - 1), at[order]

    def pairs(self, rank: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """For each two residues: a name, the places of both, and their keys in the merged order."""
        one, two = self.ahead(rank, 1), self.ahead(rank, 2)
        none = np.zeros(len(rank), np.uint64)
        for name, skipped, key in (
            ("01", 2, (self.c, one, none)),
            ("02", 1, (self.c, self.ahead(self.c, 1), two)),
            ("12", 0, (rank, none, none)),
        ):
            at = np.flatnonzero(self.mod != skipped)
            yield name, at, np.stack([k[at] for k in key], 1)


def _sorted_names(left: DataFrame, mail: DataFrame, triples: Callable[[dict, dict], np.ndarray], total: int, p: SuffixParams, kind: str) -> DataFrame:
    """Letters ``kind`` with the ranks of every chunk's distinct triples, over all chunks."""
    parts = max(1, math.ceil(total / p.part_keys))
    borders: list[tuple] = []
    if parts > 1:

        def some(row, post):
            keys = triples(row, post)
            pick = np.random.default_rng(row["chunk"].as_py()).choice(len(keys), min(SAMPLE_KEYS, len(keys)), replace=False) if len(keys) else []
            yield "sample", 0, np.ascontiguousarray(keys[pick]).tobytes()

        thin = max(1, left.select("chunk").count() // SAMPLE_CHUNKS)
        chosen = left.filter(F.pmod(F.xxhash64("chunk"), F.lit(thin)) == 0)
        sample = [bytes(r["data"]) for r in mail_pass(chosen, mail, some).select("data").collect()]
        keys = unique_rows(np.frombuffer(b"".join(sample), np.uint64).reshape(-1, 3))[0]
        borders = [tuple(keys[len(keys) * k // parts].tolist()) for k in range(1, parts)] if len(keys) else []

    def send(row, post):
        keys = unique_rows(triples(row, post))[0]
        yield from ranged(kind, keys, borders, 3)

    local = answered(mail_pass(left, mail, send), ranks, 3, kind)
    def largest(batches):
        for batch in batches:
            top = [int(np.frombuffer(d, np.uint32).max(initial=0)) + 1 for d in batch.column("data").to_pylist()]
            yield {"part": batch.column("part"), "n": top}

    found = C.arrow_map(local.select("part", "data"), largest, "part int, n long").groupBy("part").agg(F.max("n").alias("n"))
    before, start = 0, {}
    for r in sorted(found.collect()):  # a number for each part
        start[r["part"]], before = before, before + r["n"]

    def shift(batches):
        for batch in batches:
            data = [(np.frombuffer(d, np.uint32).astype(np.uint64) + np.uint64(start[k])).tobytes() for k, d in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist())]
            yield {"chunk": batch.column("chunk"), "kind": batch.column("kind"), "part": batch.column("part"), "data": data}

    return C.arrow_map(local, shift, MAIL)


def repeated_runs(runs: DataFrame, total: int, p: SuffixParams) -> DataFrame:
    """Letters with the numbers of those runs of a chunk that are equal to an earlier
    chunk's by the sorted order. ``runs``: a row of packed runs for each chunk."""
    nothing = runs.sparkSession.createDataFrame([], MAIL)

    def cover(row) -> tuple[Cover, dict]:
        r = unpack_runs(row)
        return Cover(r["phrase"], r["stretch"]), r

    def first_triples(row, post):
        c, _ = cover(row)
        return c.triples()[c.sample]

    def sample_names(c: Cover, post) -> np.ndarray:
        number = unique_rows(c.triples()[c.sample])[2]
        return np.frombuffer(post.get("name1", b""), np.uint64)[number]

    def second_triples(row, post):
        c, _ = cover(row)
        return c.names(sample_names(c, post))[0].triples()

    def merged(row, post) -> Iterator[tuple[str, np.ndarray]]:
        c, r = cover(row)
        names, at = c.names(sample_names(c, post))
        rank = np.zeros(len(c.c), np.uint64)
        rank[at] = np.frombuffer(post.get("name2", b""), np.uint64)[unique_rows(names.triples())[2]] + np.uint64(1)
        begins = np.zeros(len(rank), bool)
        begins[unique_rows(prefixes_of(r))[1]] = True  # a prefix that the chunk itself repeats is sent once
        for name, places, key in c.pairs(rank):
            sent = begins[places]
            keys = np.column_stack([key[sent], r["prefix"][places][sent], places[sent].astype(np.uint64)])
            yield name, keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]

    name1 = C.settle(_sorted_names(runs, nothing, first_triples, total, p, "name1"), "names")
    name2 = C.settle(_sorted_names(runs, name1, second_triples, total, p, "name2"), "names")
    names = name1.union(name2)
    parts = max(1, math.ceil(total * 2 / 3 / p.part_keys))  # each of the three orders leaves a residue out
    borders: dict[str, list[tuple]] = {}
    if parts > 1:

        def some(row, post):
            pick = np.random.default_rng(row["chunk"].as_py())
            for name, keys in merged(row, post):
                yield name, 0, np.ascontiguousarray(keys[np.sort(pick.choice(len(keys), min(4 * SAMPLE_KEYS, len(keys)), replace=False)), :3]).tobytes()

        thin = max(1, runs.count() // min(SAMPLE_CHUNKS, 4 * parts))
        chosen = runs.filter(F.pmod(F.xxhash64("chunk"), F.lit(thin)) == 0)
        sample: dict[str, list[tuple]] = {}
        for r in mail_pass(chosen, names, some).collect():
            sample.setdefault(r["kind"], []).extend((*key, r["chunk"]) for key in np.frombuffer(r["data"], np.uint64).reshape(-1, 3).tolist())
        for kind, keys in sample.items():
            keys.sort()
            borders[kind] = [keys[len(keys) * k // parts] for k in range(1, parts)]

    def send(row, post):
        for name, keys in merged(row, post):
            yield from ranged(name, keys, borders.get(name, []), 3, (row["chunk"].as_py(),))

    return equal_neighbours(mail_pass(runs, names, send))


def prefixes_of(runs: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([runs["prefix"], runs["phrase"]], 1)


def run_is_repeated(runs: dict[str, np.ndarray], post: dict[str, bytes]) -> np.ndarray:
    """Which runs of a chunk are equal to an earlier one's."""
    _, first, number = unique_rows(prefixes_of(runs))
    elsewhere = np.zeros(len(first), bool)
    for name in ORDERS:
        elsewhere[number[np.frombuffer(post.get(name, b""), "<u4")]] = True
    return (first[number] != np.arange(len(number))) | elsewhere[number]


# --- the whole ------------------------------------------------------------------------


def _starts(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All start positions of runs."""
    total = int(n.sum())
    return np.repeat(at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total) if total else np.empty(0, np.int64)


def _string_keys(chunk: Chunk, at: np.ndarray, n: np.ndarray, p: SuffixParams) -> np.ndarray:
    """128-bit hashes of the strings at all starts of runs (each within one document)."""
    if not len(at):
        return np.empty((0, 2), np.uint64)
    # runs that follow each other, in pieces no longer than a block
    joins = (at[1:] == at[:-1] + n[:-1]) & (np.cumsum(n)[1:] // p.block_bytes == np.cumsum(n)[:-1] // p.block_bytes)
    first = np.concatenate(([0], np.flatnonzero(~joins) + 1))
    last = np.append(first[1:] - 1, len(at) - 1)
    most = p.block_bytes + 2 * p.length
    one, two = rolling(p.length, 31, most), rolling(p.length, 47, most)
    out = []
    for a, b in zip(at[first].tolist(), (at + n)[last].tolist()):
        text = chunk.bytes[a : b + p.length - 1]
        out.append(np.stack([one(text), two(text)], 1))
    return np.concatenate(out)


def removed(docs: DataFrame, p: SuffixParams = SuffixParams(), finish: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``finish`` of doc_id, a hash of the text, the row's number among equal ones, n_bytes,
    n_removed, n_spans and kept (binary) for every row; settled."""
    spark = docs.sparkSession
    texts, buckets = chunked_texts(docs, p)
    nothing = spark.createDataFrame([], MAIL)
    size = texts.read().agg(F.sum(F.size("sizes")), F.sum(F.octet_length("text"))).first()
    n_docs, n_bytes = size[0] or 0, size[1] or 0

    text_parts = max(1, math.ceil(n_docs / p.part_keys))

    def text_letters(row, post):
        chunk = Chunk(row)
        keys = unique_rows(chunk.text_keys(chunk.long_enough(p)))[0]
        yield from hashed("copies", keys, text_parts)

    copies = answered(mail_pass(texts.read(), nothing, text_letters), held_earlier, 2, "copies")

    gram_parts = max(1, math.ceil(2 * n_bytes / (p.length - p.gram + 2) / p.part_keys))

    def gram_letters(row, post):
        chunk = Chunk(row)
        h = chunk.runs(p, chunk.copies(p, post.get("copies", b"")))["h"]
        keys = unique_rows(h.reshape(-1, 1))[0]
        yield from hashed("grams", keys, gram_parts)

    grams = answered(mail_pass(texts.read(), copies, gram_letters), held_by_others, 1, "grams")

    def run_rows(row, post):
        chunk = Chunk(row)
        runs = chunk.runs(p, chunk.copies(p, post.get("copies", b"")))
        return pack_runs(row["chunk"].as_py(), phrases(chunk, runs, shared(runs["h"], post.get("grams", b"")), p))

    kept_runs = Bucketed(chunk_pass(texts.read(), copies.union(grams), run_rows, RUN_ROW), buckets, "runs")
    runs = kept_runs.read()
    total = (runs.agg(F.sum(F.octet_length("at"))).first()[0] or 0) // 4

    equal = repeated_runs(runs, total, p)
    first_parts = max(1, math.ceil(total / p.part_keys))

    def first_letters(row, post):
        r = unpack_runs(row)
        keys = unique_rows(r["h"][~run_is_repeated(r, post)].reshape(-1, 1))[0]
        yield from hashed("firsts", keys, first_parts)

    firsts = answered(mail_pass(runs, equal, first_letters), held_by_others, 1, "firsts")

    def range_rows(row, post):
        r = unpack_runs(row)
        gone = run_is_repeated(r, post)
        stay = np.flatnonzero(~gone)
        open_ = stay[shared(r["h"][stay], post.get("firsts", b""))]
        for kind, which in (("gone", np.flatnonzero(gone)), ("open", open_)):
            yield f"{kind}_at", 0, r["at"][which].tobytes()
            yield f"{kind}_n", 0, r["n"][which].tobytes()

    ranges = C.settle(mail_pass(runs, equal.union(firsts), range_rows), "ranges")
    kept_runs.drop()

    def ranges_of(post, kind):
        return np.frombuffer(post.get(f"{kind}_at", b""), "<u4").astype(np.int64), np.frombuffer(post.get(f"{kind}_n", b""), "<u2").astype(np.int64)

    n_open = (ranges.filter("kind = 'open_at'").agg(F.sum(F.octet_length("data"))).first()[0] or 0) // 4
    string_parts = max(1, math.ceil(n_open * (p.length - p.gram + 2) / 2 / p.part_keys))

    def string_letters(row, post):
        keys = unique_rows(_string_keys(Chunk(row), *ranges_of(post, "open"), p))[0]
        yield from hashed("strings", keys, string_parts)

    strings = answered(mail_pass(texts.read(), ranges, string_letters), held_earlier, 2, "strings")

    def cut(row, post):
        chunk = Chunk(row)
        gone = np.zeros(len(chunk.bytes) + 1, bool)
        gone[_starts(*ranges_of(post, "gone"))] = True
        at, n = ranges_of(post, "open")
        _, first, number = unique_rows(_string_keys(chunk, at, n, p))
        here = _starts(at, n)
        again = (np.frombuffer(post.get("strings", b""), np.uint8)[number] > 0) | (first[number] != np.arange(len(number)))
        gone[here[again]] = True
        # a byte goes if a marked start lies at most length - 1 before it
        marked = np.flatnonzero(gone)
        edge = np.zeros(len(gone) + p.length, np.int32)
        np.add.at(edge, marked, 1)
        np.add.at(edge, marked + p.length, -1)
        covered = np.cumsum(edge, dtype=np.int32)[: len(chunk.bytes)] > 0
        whole, out = chunk.copies(p, post.get("copies", b"")), []
        for d, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist())):
            mask = np.ones(b - a, bool) if whole[d] else covered[a:b]
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
            out.append((b - a, int(mask.sum()), spans, chunk.bytes[a:b][~mask].tobytes()))
        n, cut_, spans, kept = zip(*out)
        ids = row["doc_ids"].as_py()
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "text_h": row["text_hs"].as_py(), "nth": row["nths"].as_py(), "n_bytes": n, "n_removed": cut_, "n_spans": spans,
            "kept": pa.array(kept, pa.binary()),
        })

    schema = "doc_id long, text_h long, nth int, n_bytes long, n_removed long, n_spans long, kept binary"
    found = C.settle(finish(chunk_pass(texts.read(), ranges.union(strings).union(copies), cut, schema)), "removed")
    texts.drop()
    C.discard(copies, grams, equal, firsts, ranges, strings)
    return found


def digest(docs: DataFrame, p: SuffixParams = SuffixParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed(docs, p, lambda rows: rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


def whole_characters(column: str):
    @F.arrow_udf("string")
    def decode(data: pa.Array) -> pa.Array:
        return pa.array([d.decode("utf-8", "ignore") for d in data.to_pylist()], pa.string())

    return decode(column)


def drop_repeats(docs: DataFrame, p: SuffixParams = SuffixParams()) -> DataFrame:
    """``docs`` with what is left of each text. What is left of a character that lost
    some of its bytes goes too, so texts stay valid UTF-8; null texts stay null."""
    id_, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.col("text").cast("string")
    rows = docs.select(
        id_.alias("_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text_h"),
        text.isNull().alias("_null"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"),
    )
    # equal rows are told apart by number only: one of them keeps its text
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_text_h").orderBy("_null")))
    kept = removed(docs, p).select(
        F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.col("text_h").alias("_text_h"), F.col("nth").alias("_nth"),
        whole_characters("kept").alias("_kept"),
    )
    both = rows.join(kept, ["_id", "_text_h", "_nth"])
    return both.select(
        *[(F.when(~F.col("_null"), F.col("_kept")) if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    )
