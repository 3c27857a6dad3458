"""Token ids of whole texts with a public tokenizer, at the cost of its new words.

A text's ids are those of its words (runs between ASCII white space) in a row: the
vocabulary's pre-tokenizer drops white space and never joins across it. So a task
encodes each distinct word once and looks the rest up. ``tests/llm`` holds the result
against the library on whole texts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Words that a Python worker remembers (some 50 bytes each); beyond that it starts afresh.
WORDS_HELD = 1_200_000
#: New words encoded in one call of the library.
WORDS_A_CALL = 2_000


#: Bytes with A-Z in lower case; full stops and commas; ASCII letters and digits; all but ASCII white space.
FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)
STOP = np.isin(np.arange(256), list(b".,"))
WORDLY = np.array([bytes([k]).isalnum() for k in range(256)])
INSIDE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # for words of a-z the vocabulary's normalizer has nothing to do and its patterns nothing to split
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for piece, i in vocabulary.items():
            self.ends_word[i] = piece.endswith("</w>")
        self._forget()

    def _ask(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words, many in a call. A word of letters alone ends at the first piece
        that ends a word; for other words the library's offsets tell."""
        out: dict[bytes, bytes] = {}
        small = [w for w in words if w.isalpha() and w.islower()]
        letters = [w for w in words if not w.isascii() and w.decode().isalpha()]
        other = list(set(words).difference(small, letters))
        for some, library in ((small, self.bare), (letters, self.library), (other, None)):
            for k in range(0, len(some), WORDS_A_CALL):
                asked = some[k : k + WORDS_A_CALL]
                line = b" ".join(asked).decode()
                cut = self._ends(library, line, len(asked)) if library else None
                if cut is None:
                    found = self.library.encode(line, add_special_tokens=False)
                    starts = np.cumsum([0, *(len(w.decode()) + 1 for w in asked)])
                    at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.offsets))
                    cut = np.array(found.ids, dtype="<u4"), np.searchsorted(at, starts)
                ids, places = cut[0].tobytes(), (cut[1] * 4).tolist()
                out.update(zip(asked, [ids[a:b] for a, b in zip(places, places[1:])]))
        return out

    def _ends(self, library, line: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.array(library.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        return (ids, np.concatenate(([0], ends))) if len(ends) == n and ends[-1] == len(ids) else None

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts in a row, and how many each text has. The vocabulary
        ignores case, but its special tokens don't. Full stops and commas after a letter
        or digit are words of their own to it, so they are here."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, cuts, data = texts.buffers()
        edges = np.frombuffer(cuts, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        folded = FOLD[raw]
        for special in self.special:
            line, at = folded.tobytes(), -1
            while (at := line.find(special, at + 1)) >= 0:
                k = np.searchsorted(edges, at, side="right") - 1
                folded[edges[k] : edges[k + 1]] = raw[edges[k] : edges[k + 1]]
                at = int(edges[k + 1]) - 1
        inside = INSIDE[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = edges[:-1] < edges[1:]
        begins[edges[:-1][full]] = inside[edges[:-1][full]]
        ends[edges[1:][full] - 1] = inside[edges[1:][full] - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        stops_at = np.concatenate([starts, self._stops(folded, starts, stops)])
        stops = np.concatenate([stops, stops_at[len(starts) :]])
        starts = np.sort(stops_at)
        stops = np.sort(stops)
        offsets = np.concatenate(([0], np.cumsum(stops - starts)))
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(folded[inside])]
        )
        return words, np.diff(np.searchsorted(starts, edges))

    def _stops(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the full stops and commas at the ends of words begin, after a letter or digit."""
        found = []
        at = ends - 1
        while len(at):
            going = (STOP[text[at]]) & (at > starts)
            at, starts = at[going] - 1, starts[going]
            found.append(at[WORDLY[text[at]]] + 1)
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def _places(self, words: pa.Array) -> np.ndarray:
        """The number of each word among those known, which it becomes first."""
        if len(self.words) > WORDS_HELD:
            self._forget()
        at = pc.index_in(words, value_set=self.words)
        if not at.null_count:
            return at.to_numpy(zero_copy_only=False)
        missing = pc.is_null(at).to_numpy(zero_copy_only=False)
        asked = words.filter(pa.array(missing))
        new = asked.unique()
        before = len(self.words)
        self._learn(new)
        out = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).copy()
        out[missing] = pc.index_in(asked, value_set=new).to_numpy(zero_copy_only=False) + before
        return out

    def _learn(self, new: pa.Array) -> None:
        names = new.to_pylist()
        answers = self._ask(names)
        ids = [answers[w] for w in names]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        self.words = pa.concat_arrays([self.words, new])

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.ids, self.start, self.size = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (nulls: none) in a row, each with ``end_id`` after it, and
        where each text's begin and end."""
        words, per_text = self._words(texts)
        places = self._places(words)
        flat = np.append(self.ids, np.array([] if end_id is None else [end_id], "<u4"))
        text_ends = np.cumsum(per_text + 1)  # every text's words, then the end
        size = np.empty(int(text_ends[-1]) if len(text_ends) else 0, np.int64)
        start = np.full(len(size), len(self.ids))
        is_word = np.ones(len(size), bool)
        is_word[text_ends - 1] = False
        size[~is_word] = end_id is not None
        size[is_word], start[is_word] = self.size[places], self.start[places]
        ends = np.cumsum(size)
        at = np.repeat((start - ends + size).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], np.concatenate(([0], ends[text_ends - 1])) if len(text_ends) else np.zeros(1, np.int64)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        ids, edges = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_batches(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int = END_ID
) -> Iterator[tuple[pa.Array, list[memoryview]]]:
    """Document ids and id arrays (32-bit, the end id last), slice by slice. A null
    text is an empty one."""
    encode = encoder(path).encode
    for part in C.slices(batches, "text"):
        ids, edges = encode(part.column("text"), end_id)
        raw, cuts = memoryview(ids.tobytes()), (edges * 4).tolist()
        yield part.column("doc_id"), [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def texts_of(docs: DataFrame) -> DataFrame:
    """The two columns that operators on documents read, whatever else there is."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def crc(data: bytes | memoryview) -> int:
    return zlib.crc32(data)
