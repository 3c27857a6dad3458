"""Token ids as files of separately compressed documents with one shared dictionary.

A zstandard dictionary is trained on ``dictionary_windows`` windows of serialized ids, of at
most ``dictionary_window_bytes`` each (the documented bound of the sample, 8 MB). Windows lie
anywhere in the whole id arrays of any document: texts are divided in as many places as they
are long, and the places with the smallest hashes are taken, so each part of the corpus counts
by its bytes. Tasks encode and cut; the driver gets the windows alone. Every document is then
one frame, so a short document is read without its neighbours and still profits from what all
documents share.

Layout. A table of blocks, ``bucket, block, first_token, n_docs, n_tokens, bytes``,
written by Spark (its commit protocol covers lost tasks) with Parquet compression
off. Buckets are ranges of document ids, so (bucket, block) is ascending document
order. ``bytes`` of a block:

    magic "TOKB", version, id width (2 or 4), number of documents, SHA-256 of the dictionary
    index: document id, has an id, end of its frame, number of ids    (one entry each)
    frames, one for each document

``first_token`` counts the ids of earlier blocks of the bucket. The dictionary is
stored beside the blocks; readers refuse blocks of another dictionary.

Null texts are empty documents (the end id alone). Null document ids come first.
Repeated rows are written each. An empty table gives an empty table of blocks.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalgraph.llm import common as C
from signalgraph.llm import tokens as K

HEAD = struct.Struct("<4sHHI32s")
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("end", "<u8"), ("n_tokens", "<u4")])
MAGIC, VERSION = b"TOKB", 1
#: Bytes of text for each place of a window.
PLACE_BYTES = 16 * 1024


@dataclass(frozen=True)
class FileParams:
    end_id: int = K.END_ID
    vocabulary: str = ""
    id_width: int = 2  # bytes; 4 for vocabularies beyond 65,536
    level: int = 3
    dictionary_bytes: int = 64 * 1024
    dictionary_windows: int = 1_000
    dictionary_window_bytes: int = 8 * 1024
    block_bytes: int = 2 * 1024 * 1024
    bucket_bytes: int = 32 * 1024 * 1024  # of text


class Codec:
    def __init__(self, dictionary: bytes, level: int = 3):
        self.digest = hashlib.sha256(dictionary).digest()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=level)
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared).decompress


def sample_windows(docs: DataFrame, p: FileParams) -> DataFrame:
    """h, data: serialized ids of the windows chosen, about half as many again as asked for."""
    places = (F.coalesce(F.octet_length("text"), F.lit(0)) / F.lit(PLACE_BYTES)).cast("int") + 1
    spread = K.texts_of(docs).select("text", F.xxhash64("doc_id", "text").alias("h"), places.alias("places"))
    total = spread.agg(F.sum("places")).first()[0] or 0
    share = int(min(1.0, 1.5 * p.dictionary_windows / max(total, 1)) * (1 << 30)) + 1
    luck = lambda k: F.pmod(F.xxhash64("h", k), F.lit(1 << 30))
    chosen = spread.withColumn("at", F.filter(F.sequence(F.lit(0), F.col("places") - 1), lambda k: luck(k) < share))
    path, width, window = p.vocabulary or K.vocabulary_path(), p.id_width, p.dictionary_window_bytes // p.id_width

    def cut(batches: Iterator[pa.RecordBatch]):
        encode = K.encoder(path).encode
        for part in C.slices(batches, "text"):
            ids, edges = encode(part.column("text"))
            ids = np.frombuffer(serialize(ids.tobytes(), width), f"<u{width}")
            hashes, data = [], []
            rows = zip(edges, edges[1:], part.column("h").to_pylist(), part.column("places").to_pylist(), part.column("at").to_pylist())
            for first, end, h, places, at in rows:
                for k in at:
                    start = first + (end - first) * k // places
                    hashes.append(xxhash.xxh64_intdigest(struct.pack("<qq", h, k)) >> 1)
                    data.append(ids[start : min(end, start + window)].tobytes())
            yield {"h": hashes, "data": data}

    return C.arrow_map(chosen.filter(F.size("at") > 0), cut, "h long, data binary")


def train_dictionary(docs: DataFrame, p: FileParams) -> bytes:
    """From a bounded sample; empty where there is too little to learn from."""
    arrays = [bytes(r["data"]) for r in sample_windows(docs, p).orderBy("h", "data").limit(p.dictionary_windows).collect()]
    size = min(p.dictionary_bytes, sum(map(len, arrays)) // 8)
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


def serialize(ids: bytes, width: int) -> bytes:
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError(f"token id {wide.max()} needs an id_width of 4")
    return wide.astype("<u2").tobytes()


def restore(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def block_bytes(entries: list[tuple], frames: list[bytes], digest: bytes, width: int) -> bytes:
    index = np.empty(len(entries), ENTRY)
    ends = np.cumsum([len(f) for f in frames])
    for i, (doc_id, n) in enumerate(entries):
        index[i] = (doc_id or 0, doc_id is not None, ends[i], n)
    return HEAD.pack(MAGIC, VERSION, width, len(entries), digest) + index.tobytes() + b"".join(frames)


def open_block(data: bytes, digest: bytes) -> tuple[int, np.ndarray, memoryview]:
    """Id width, index and frames."""
    magic, version, width, n, kept = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or kept != digest:
        raise ValueError("not a token block of this version and dictionary")
    index = np.frombuffer(data, ENTRY, n, HEAD.size)
    return width, index, memoryview(data)[HEAD.size + index.nbytes :]


def document_ids(data: bytes, place: int, codec: Codec) -> bytes:
    """Ids (32-bit) of one document of a block, by its place in the index."""
    width, index, frames = open_block(data, codec.digest)
    start = int(index["end"][place - 1]) if place else 0
    return restore(codec.unpack(frames[start : int(index["end"][place])]), width)


def write_token_blocks(docs: DataFrame, dictionary: bytes, p: FileParams = FileParams()) -> DataFrame:
    """The table of blocks, lazily; write it as Parquet to keep it."""
    docs, path = K.texts_of(docs), p.vocabulary or K.vocabulary_path()
    bounds = C.id_bounds(docs, p.bucket_bytes)
    end, level, width, most = p.end_id, p.level, p.id_width, p.block_bytes

    def compress(batches):
        pack, edges = Codec(dictionary, level).pack, np.array(bounds, np.int64)
        for doc_ids, arrays in K.encode_batches(batches, path, end):
            known = pc.fill_null(doc_ids, -(2**63)).to_numpy(zero_copy_only=False)
            yield {
                "bucket": np.searchsorted(edges, known, side="right").astype(np.int32),
                "doc_id": doc_ids,
                "n_tokens": [len(a) // 4 for a in arrays],
                "frame": [pack(serialize(a, width)) for a in arrays],
            }

    frames = C.arrow_map(docs, compress, "bucket int, doc_id long, n_tokens int, frame binary")
    dealt = frames.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "frame")

    def block(batches):
        digest = Codec(dictionary, level).digest
        state = {"bucket": None, "block": 0, "before": 0}
        entries: list[tuple] = []
        kept: list[bytes] = []

        def flush():
            n = sum(e[1] for e in entries)
            row = {
                "bucket": [state["bucket"]], "block": [state["block"]], "first_token": [state["before"]], "n_docs": [len(entries)],
                "n_tokens": [n], "bytes": [block_bytes(entries, kept, digest, width)],
            }
            state["block"] += 1
            state["before"] += n
            entries.clear()
            kept.clear()
            return row

        size = 0
        for batch in C.slices(batches, "frame"):
            for bucket, doc_id, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if entries and (size + len(frame) > most or bucket != state["bucket"]):
                    yield flush()
                    size = 0
                if bucket != state["bucket"]:
                    state |= {"bucket": bucket, "block": 0, "before": 0}
                entries.append((doc_id, n))
                kept.append(frame)
                size += len(frame)
        if entries:
            yield flush()

    fields = "bucket int, block int, first_token long, n_docs int, n_tokens long, bytes binary"
    return C.arrow_map(dealt, block, fields)


def save(docs: DataFrame, path: str, p: FileParams = FileParams()) -> None:
    """Blocks and dictionary below ``path``."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, p)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.parquet(f"{path}/dictionary")
    with C.small_batches(spark):
        write_token_blocks(docs, dictionary, p).write.option("compression", "none").parquet(f"{path}/blocks")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    return spark.read.parquet(f"{path}/blocks"), bytes(spark.read.parquet(f"{path}/dictionary").first()[0])


def read_documents(blocks: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def unpack(batches: Iterator[pa.RecordBatch]):
        codec = Codec(dictionary)
        for batch in C.slices(batches, "bytes"):
            for bucket, before, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "first_token", "bytes"))):
                width, index, frames = open_block(data, codec.digest)
                ends = index["end"].tolist()
                crc = [K.crc(restore(codec.unpack(frames[a:b]), width)) for a, b in zip([0, *ends], ends)]
                n = index["n_tokens"].astype(np.int64)
                yield {
                    "doc_id": pa.array(index["doc_id"], mask=index["has_id"] == 0),
                    "bucket": np.full(len(n), bucket, np.int32),
                    "before": before + np.cumsum(n) - n,
                    "n_tokens": n,
                    "ids_crc32": crc,
                }

    rows = C.arrow_map(
        blocks.select("bucket", "first_token", "bytes"), unpack, "doc_id long, bucket int, before long, n_tokens long, ids_crc32 long"
    )
    totals = blocks.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    return rows.join(C.with_offsets(totals, "bucket", "n", "earlier"), "bucket").select(
        "doc_id", (F.col("earlier") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
