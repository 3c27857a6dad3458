"""N-best segmentation into SentencePiece pieces, and decoding.

The pieces of a model span a lattice over a text; a segmentation's score is the sum
of its pieces' scores in the model file. A forward Viterbi pass gives every position
the score of its best prefix. That is the exact heuristic for an A* search backwards
from the end, which therefore meets the N best segmentations in order and expands
nothing else.

Texts fall into chunks that no piece crosses (a run of spaces with the word after it;
a line break alone), which the model is asked for at the start. The forward pass of a
chunk also yields by how much its second segmentation is worse: the least loss at a
position of the best path when it is entered by another piece. Only the N-1 chunks of
a document with the least such loss can differ from the best in one of its N best
segmentations, so only those are searched; their lists are then merged. Equal scores
go by the order of positions; of equal paths through a chunk the one with the
longest last pieces leads.

A character without a piece is its UTF-8 bytes, with a score below all pieces.
Spaces become ``▁`` and one is put in front, as the model's own encoder does.

Null texts are empty; an empty text has one segmentation, without pieces. Texts with
fewer than N segmentations have as many rows as they have. Repeated rows come back
each; an empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from signalgraph.llm import common as C
from signalgraph.llm import tokens as K

MODEL = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
CHUNKS_HELD = 1_400_000  # some 200 bytes each
CHUNK_CHARS_HELD = 48
STOPS = ".,"


@dataclass(frozen=True)
class NBestParams:
    n: int = 4
    model: str = ""  # path; empty: the public one


pack_ids = struct.pack


def ids_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Pieces:
    """Lattice of a model's pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.vocab_size())
        names = [model.id_to_piece(i) for i in size]
        usual = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {names[i]: (float(model.get_score(i)), i) for i in usual}
        self.byte = {int(names[i][3:5], 16): i for i in size if model.is_byte(i)}
        self.unknown = model.unk_id()
        #: Every beginning of a piece; empty where it is no piece itself.
        self.starts: dict[str, tuple] = {name[:k]: () for name in self.score for k in range(1, len(name))} | self.score
        self.longest = max(map(len, self.score))
        self.penalty = min(s for s, _ in self.score.values()) - UNKNOWN_PENALTY
        self.plain: list[bytes] = [names[i].replace(MARK, " ").encode() for i in size]
        for value, i in self.byte.items():
            self.plain[i] = bytes([value])
        for i in size:
            if model.is_control(i):
                self.plain[i] = b""
        if any(MARK in name.lstrip(MARK) or ("\n" in name and name != "\n") for name in self.score):
            raise ValueError("a piece crosses a space or line break")
        size_of = [len(x) for x in self.plain]
        self.text = np.frombuffer(b"".join(self.plain), np.uint8)
        self.size = np.array(size_of, np.int64)
        self.begin = np.cumsum(self.size) - self.size
        #: Whether stops at the end of a word can be segmented apart from it.
        self.stops_apart = not any(x[k].isalpha() and x[k + 1] in STOPS for x in self.score for k in range(len(x) - 1))
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte.get(b, self.unknown) for b in char.encode())

    def forward(self, chunk: str) -> tuple[list[float], list[list[tuple[float, int, tuple[int, ...] | int]]]]:
        """Best score of each prefix; for each position its entering pieces as
        (score of the best path through it, where it starts, id or ids)."""
        look, longest, n = self.score.get, self.longest, len(chunk)
        best, into = [0.0], [[]]
        for j in range(1, n + 1):
            ways = []
            for i in range(j - 1, max(-1, j - 1 - longest), -1):
                found = look(chunk[i:j])
                if found is not None:
                    ways.append((best[i] + found[0], i, found[1]))
                elif i == j - 1:
                    ways.append((best[i] + self.penalty, i, self.fallback(chunk[i])))
            best.append(max(w[0] for w in ways))
            into.append(ways)
        return best, into

    def first(self, chunk: str) -> tuple[bytes, float, float]:
        """Ids and score of the best segmentation, and the loss of the second (infinite if there is none)."""
        got = self.known.get(chunk)
        if got is not None:
            return got
        core = chunk.rstrip(STOPS)
        if self.stops_apart and len(core) < len(chunk) and core[-1:].isalpha():
            word, stops = self.first(core), self.first(chunk[len(core) :])
            return self._keep(chunk, (word[0] + stops[0], word[1] + stops[1], min(word[2], stops[2])))
        look, longest, n, never = self.starts.get, self.longest, len(chunk), float("-inf")
        best, second, came, used = [0.0] + [never] * n, [never] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        for i in range(n):
            base = best[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                found = look(chunk[i:j])
                if found is None:
                    break
                if found:
                    score = base + found[0]
                    if score > best[j]:
                        second[j], best[j], came[j], used[j] = best[j], score, i, found[1]
                    elif score > second[j]:
                        second[j] = score
            if chunk[i] not in self.score:
                score = base + self.penalty
                if score > best[i + 1]:
                    second[i + 1], best[i + 1], came[i + 1], used[i + 1] = best[i + 1], score, i, self.fallback(chunk[i])
                elif score > second[i + 1]:
                    second[i + 1] = score
        ids, loss, j = [], float("inf"), n
        while j:
            loss = min(loss, best[j] - second[j])
            ids.extend(reversed(used[j]) if isinstance(used[j], tuple) else (used[j],))
            j = came[j]
        return self._keep(chunk, (pack_ids(f"<{len(ids)}I", *ids[::-1]), best[n], loss))

    def _keep(self, chunk: str, got: tuple[bytes, float, float]) -> tuple[bytes, float, float]:
        if len(chunk) <= CHUNK_CHARS_HELD:
            if len(self.known) >= CHUNKS_HELD:
                self.known.clear()
            self.known[chunk] = got
        return got

    def best_n(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """Loss against the best, and ids, of the ``n`` best segmentations: A* from the end.
        Of equal losses the one nearest the start goes on, and no place is left more than
        ``n`` times, so that a run of one character costs what its length does."""
        got = self.lists.get((chunk, n))
        if got is not None:
            return got
        best, into = self.forward(chunk)
        order, out = 0, []
        left = [n] * (len(chunk) + 1)
        ways: dict[int, list[tuple[float, int, object]]] = {}  # into a place, the least loss first
        # loss rounded (equal sums in another order differ in their last digits), place, order, loss,
        # pieces after it, and where among its siblings it stands: only the next of them waits
        heap: list[tuple] = [(0.0, len(chunk), 0, 0.0, None, None)]
        while heap and len(out) < n:
            _, j, _, loss, path, among = heapq.heappop(heap)
            if among is not None:
                parent, base, after, k = among
                if k + 1 < len(ways[parent]):
                    order += 1
                    self._wait(heap, ways[parent], parent, base, after, k + 1, order)
            if not left[j]:
                continue
            left[j] -= 1
            if not j:
                ids = []
                while path:
                    ids.extend(path[0] if isinstance(path[0], tuple) else (path[0],))
                    path = path[1]
                out.append((loss, ids_bytes(ids)))
                continue
            if j not in ways:
                ways[j] = sorted(((best[j] - score, i, piece) for score, i, piece in into[j]), key=lambda w: w[:2])
            order += 1
            self._wait(heap, ways[j], j, loss, path, 0, order)
        out.sort(key=lambda w: w[0])
        top = self.first(chunk)[0]  # of equals, the same one leads
        out = [(0.0, top), *(w for w in out if w[1] != top)][:n]
        if len(chunk) <= CHUNK_CHARS_HELD:
            if len(self.lists) >= CHUNKS_HELD // 16:
                self.lists.clear()
            self.lists[chunk, n] = out
        return out

    @staticmethod
    def _wait(heap: list, ways: list, parent: int, base: float, after, k: int, order: int) -> None:
        more, i, piece = ways[k]
        heapq.heappush(heap, (round(base + more, 9), i, order, base + more, (piece, after), (parent, base, after, k)))

    def chunks(self, text: str) -> list[str]:
        """Of a whole text; their concatenation is the text as the model sees it."""
        if not text:
            return []
        out: list[str] = []
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            if k:
                out.append("\n")
            words = line.split(" ")
            if "" not in words:
                if k:
                    out.append(words[0])
                    out.extend([MARK + w for w in words[1:]])
                else:
                    out.extend([MARK + w for w in words])
                continue
            run = MARK if not k else ""
            for w in words:
                if w:
                    out.append(run + w)
                    run = MARK
                else:
                    run += MARK
            if run[:-1]:
                out.append(run[:-1])
        return out

    def segment(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """Score and ids of the ``n`` best segmentations, best first."""
        chunks = self.chunks(text)
        look = self.known.get
        found = [look(c) or self.first(c) for c in chunks]
        total = sum([f[1] for f in found])
        parts = [f[0] for f in found]
        out = [(total, b"".join(parts))]
        if n > 1:
            losses = [f[2] for f in found]
            least = sorted(heapq.nsmallest(n - 1, range(len(losses)), key=losses.__getitem__))
            mixes: list[tuple[float, tuple]] = [(0.0, ())]
            for at in least:
                if losses[at] == float("inf"):
                    mixes = [(loss, (*picked, 0)) for loss, picked in mixes]
                    continue
                ways = self.best_n(chunks[at], n)
                mixes = heapq.nsmallest(n, [(loss + w[0], (*picked, k)) for loss, picked in mixes for k, w in enumerate(ways)])
            for loss, picked in mixes[1:]:
                other = list(parts)
                for at, k in zip(least, picked):
                    if k:
                        other[at] = self.best_n(chunks[at], n)[k][1]
                out.append((total - loss, b"".join(other)))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, the space in front left out."""
        at = np.frombuffer(ids, "<u4")
        size = self.size[at]
        ends = np.cumsum(size)
        places = np.repeat(self.begin[at] - ends + size, size)
        places += np.arange(len(places))
        text = self.text[places].tobytes()
        return text[1:] if text[:1] == b" " else text


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _each(docs: DataFrame, p: NBestParams, columns: str, describe) -> DataFrame:
    path, n = p.model or K.vocabulary_path(MODEL), p.n

    def run(batches: Iterator[pa.RecordBatch]):
        model = pieces(path)
        for part in C.slices(batches, "text", 2_000_000):
            rows: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                for rank, (score, ids) in enumerate(model.segment(text or "", n), 1):
                    rows.append((doc_id, rank, score, *describe(model, text or "", ids)))
            names = ["doc_id", "rank", "score", *(c.split()[0] for c in columns.split(", "))]
            yield dict(zip(names, zip(*rows)))

    return C.arrow_map(K.texts_of(docs), run, f"doc_id long, rank int, score double, {columns}")


def segmentations(docs: DataFrame, p: NBestParams = NBestParams()) -> DataFrame:
    """doc_id, rank (from 1), score, ids."""
    return _each(docs, p, "ids array<int>", lambda model, text, ids: (np.frombuffer(ids, "<u4").astype(np.int32).tolist(),))


def decoded(segmented: DataFrame, p: NBestParams = NBestParams()) -> DataFrame:
    """doc_id, rank, text of ``segmentations``. A literal ``▁`` of a text comes back as a space."""
    path = p.model or K.vocabulary_path(MODEL)

    def run(batches):
        model = pieces(path)
        for batch in batches:
            texts = [model.decode(ids_bytes(ids)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "rank": batch.column("rank"), "text": texts}

    return C.arrow_map(segmented.select("doc_id", "rank", "ids"), run, "doc_id long, rank int, text string")


def digest(docs: DataFrame, p: NBestParams = NBestParams()) -> DataFrame:
    """doc_id, rank, score, n_pieces, ids_crc32, round_trip (its decoding is the text)."""

    def describe(model, text, ids):
        return len(ids) // 4, K.crc(ids), model.decode(ids) == text.replace(MARK, " ").encode()

    return _each(docs, p, "n_pieces long, ids_crc32 long, round_trip boolean", describe)
