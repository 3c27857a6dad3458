"""Finds stretches of words that repeat with a period, and keeps one period of each.

A run is a stretch of consecutive words (between ASCII white space) with smallest period
q, at least ``min_length`` words and ``min_periods`` times q long, that no neighbouring
word extends. Of each text, in the task that holds its row:

1. Stretches that can hold a run are found for a batch of texts at once. In a run every
   window of ``RunParams.window`` words occurs again q words away, and q is a bounded share
   of the run; words in no such window are in no run. Windows go by 64-bit hashes, so a
   stretch may be too long, never too short.
2. Re-Pair: the most frequent pair of a stretch's word ids becomes a nonterminal until no
   pair is left twice. The start sequence is halved near its middle, again and again.
3. A run lies whole in the lowest nonterminal (or part of the start sequence) that holds
   all of it, and crosses the boundary between its two sides. So runs across the boundary
   are worked out once for each nonterminal: for every period, how far equal words reach
   forwards and backwards of the boundary, from two Z functions (Main and Lorentz).
4. What is found in a nonterminal holds wherever the derivation has it. Intervals of one
   period that overlap by a period are merged; of equal intervals the smallest period stays.

Rows are independent: there is no shuffle, and a document is the largest thing a task holds.

A null or empty text has no words and no runs. Repeated rows give equal rows. Columns other
than ``text`` are carried along (``digest`` reads ``doc_id`` and ``text`` only).
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C
from signalgraph.llm import tokens as K

Run = tuple[int, int, int]  # start, end, period
FAR = np.iinfo(np.int64).max // 1024


@dataclass(frozen=True)
class RunParams:
    min_length: int = 24
    min_periods: int = 3

    def __post_init__(self) -> None:
        if self.min_periods < 2 or self.min_length < 1:
            raise ValueError("a run has at least two periods and one word")

    @property
    def window(self) -> int:
        """The longest window that recurs a period away wherever it lies in a run: a run of
        length L and period q allows L - 2q + 1."""
        return self.min_length * (self.min_periods - 2) // self.min_periods + 1


# --- stretches that can hold a run ----------------------------------------------------


def stretches(ids: np.ndarray, ends: np.ndarray, p: RunParams) -> list[tuple[int, int]]:
    """Where runs can be, as (from, to), in word ids of several texts that end at ``ends``."""
    g, n = p.window, len(ids)
    if n < p.min_length:
        return []
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = np.flatnonzero(text[: n - g + 1] == text[g - 1 :])
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n - g + 1, np.uint64)
    for k in range(g):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : n - g + 1 + k]
    h = (h ^ (h >> np.uint64(31))) + text[: n - g + 1].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    key = h[inside]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    earlier, later = inside[order[same]], inside[order[same + 1]]
    near = np.full(n, FAR, np.int64)  # words to the nearest equal window of the text
    near[earlier] = later - earlier
    near[later] = np.minimum(near[later], later - earlier)
    starts = np.flatnonzero(near < FAR)
    while len(starts):
        # a gap between windows, or the next text, begins another stretch
        fresh = np.flatnonzero(np.r_[True, (np.diff(starts) > g) | (np.diff(text[starts]) > 0)])
        size = starts[np.r_[fresh[1:], len(starts)] - 1] + g - starts[fresh]
        of = np.repeat(np.arange(len(fresh)), np.diff(np.r_[fresh, len(starts)]))
        stay = (near[starts] * p.min_periods <= size[of]) & (size[of] >= p.min_length)
        if stay.all():
            return [(int(a), int(a + s)) for a, s in zip(starts[fresh], size)]
        starts = starts[stay]
    return []


# --- Re-Pair ----------------------------------------------------------------------------


class Grammar:
    """``rules[k]`` are the two sides of nonterminal ``base + k``; ``size`` and ``first`` are
    its length and one place of it. ``start`` is what is left, with the place of each symbol."""

    def __init__(self, words: list[int]) -> None:
        n = len(words)
        known: dict[int, int] = {}
        sym = [known.setdefault(w, len(known)) for w in words]
        self.base = len(known)
        self.rules: list[tuple[int, int]] = []
        self.size = [1] * self.base
        self.first = [0] * self.base
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, pair in enumerate(zip(sym, sym[1:])):
            where[pair].append(i)
        queue = [(-len(at), pair) for pair, at in where.items() if len(at) > 1]
        heapify(queue)
        while queue:
            count, (a, b) = heappop(queue)
            places = where.pop((a, b), None)
            if places is None:
                continue
            valid = [i for i in places if sym[i] == a and (j := after[i]) < n and sym[j] == b]
            live, taken = valid, -1
            if a == b:  # places, in order, may overlap the one before
                live = []
                for i in valid:
                    if i != taken:
                        live.append(i)
                        taken = after[i]
            if len(live) < 2:
                continue
            if len(live) < -count:  # others may be more frequent now
                where[a, b] = valid
                heappush(queue, (-len(live), (a, b)))
                continue
            new = self.base + len(self.rules)
            self.rules.append((a, b))
            self.size.append(self.size[a] + self.size[b])
            self.first.append(live[0])
            made: dict[tuple[int, int], list[int]] = defaultdict(list)
            for i in live:
                j = after[i]
                k = after[j]
                sym[i], sym[j], after[i] = new, -1, k
                if k < n:
                    before[k] = i
                    made[new, sym[k]].append(i)
                if (h := before[i]) >= 0:
                    made[sym[h], new].append(h)
            for pair, at in made.items():
                if len(at) > 1:
                    where[pair] = at
                    heappush(queue, (-len(at), pair))
        self.start: list[tuple[int, int]] = []
        i = 0
        while i < n:
            self.start.append((sym[i], i))
            i = after[i]


# --- runs across a boundary --------------------------------------------------------------


def z_values(s: list[int], upto: int) -> list[int]:
    """How far ``s`` from each of the first ``upto`` places on equals its own beginning."""
    n = len(s)
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(words: list[int], a: int, c: int, b: int, p: RunParams) -> list[Run]:
    """Runs inside ``words[a:b]`` that hold both words beside ``c``, for every period."""
    m = b - a
    most = m // p.min_periods
    if m < p.min_length or not most:
        return []
    u, v = words[a:c], words[c:b]
    nu, nv = len(u), len(v)
    ku, kv = min(nu, most), min(nv, most)
    # forwards: v on v, and v on what begins up to ku words before it; -1 is no word
    ahead = z_values([*v, -1, *u[nu - ku :], *v], nv + 1 + ku)
    back = u[::-1]
    behind = z_values([*back, -1, *v[:kv][::-1], *back], nu + 1 + kv)
    found = []
    for q in range(1, most + 1):
        least = max(p.min_length, p.min_periods * q)
        if q <= nv:  # a whole period lies after the boundary
            lo, hi = behind[nu + 1 + kv - q], q + (ahead[q] if q < nv else 0)
            if lo and lo + hi >= least:
                found.append((c - lo, c + hi, q))
        if q <= nu:  # or before it
            lo, hi = q + (behind[q] if q < nu else 0), ahead[nv + 1 + ku - q]
            if hi and lo + hi >= least:
                found.append((c - lo, c + hi, q))
    return found


def halves(starts: list[int], end: int, least: int) -> list[tuple[int, int, int]]:
    """The start sequence as a tree: (from, boundary, to) of every part of two or more symbols."""
    cuts = np.array(starts)
    parts, todo = [], [(0, len(starts))]
    while todo:
        lo, hi = todo.pop()
        a, b = starts[lo], starts[hi] if hi < len(starts) else end
        if hi - lo < 2 or b - a < least:
            continue
        mid = int(np.searchsorted(cuts, (a + b) // 2))
        mid = min(max(mid, lo + 1), hi - 1)
        if mid > lo + 1 and (a + b) - 2 * starts[mid - 1] < 2 * starts[mid] - (a + b):
            mid -= 1
        parts.append((a, starts[mid], b))
        todo += [(lo, mid), (mid, hi)]
    return parts


def stretch_runs(words: list[int], p: RunParams) -> list[Run]:
    """All runs of a stretch, by start, then period."""
    g = Grammar(words)
    own: list[list[Run]] = [[] for _ in g.size]  # runs across the boundary, from the nonterminal's start
    holds = [False] * len(g.size)
    for k, (x, y) in enumerate(g.rules):
        s = g.base + k
        if g.size[s] >= p.min_length:
            at = g.first[s]
            own[s] = [(i - at, j - at, q) for i, j, q in crossing(words, at, at + g.size[x], at + g.size[s], p)]
        holds[s] = bool(own[s]) or holds[x] or holds[y]
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for part in halves([i for _, i in g.start], len(words), p.min_length):
        for i, j, q in crossing(words, *part, p):
            found[q].append((i, j))
    todo = [(s, at) for s, at in g.start if holds[s]]
    while todo:
        s, at = todo.pop()
        for i, j, q in own[s]:
            found[q].append((at + i, at + j))
        x, y = g.rules[s - g.base]
        if holds[x]:
            todo.append((x, at))
        if holds[y]:
            todo.append((y, at + g.size[x]))
    period: dict[tuple[int, int], int] = {}
    for q in sorted(found):
        for part in merged(sorted(set(found[q])), q):
            period.setdefault(part, q)
    return sorted((i, j, q) for (i, j), q in period.items())


def merged(parts: list[tuple[int, int]], q: int) -> list[tuple[int, int]]:
    """Sorted intervals of period ``q``; those that overlap by a period are one."""
    out = parts[:1]
    for i, j in parts[1:]:
        a, b = out[-1]
        if i <= b - q:
            out[-1] = (a, max(b, j))
        else:
            out.append((i, j))
    return out


# --- texts -------------------------------------------------------------------------------


def runs_of_texts(texts: list[list[bytes]], p: RunParams) -> list[list[Run]]:
    """Runs of each text, given as its words."""
    known: dict[bytes, int] = {}
    counts = [len(words) for words in texts]
    ids = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64, sum(counts))
    ends = np.cumsum(counts)
    out: list[list[Run]] = [[] for _ in texts]
    for a, b in stretches(ids, ends, p):
        r = int(np.searchsorted(ends, a, side="right"))
        off = a - int(ends[r] - counts[r])
        out[r] += [(i + off, j + off, q) for i, j, q in stretch_runs(ids[a:b].tolist(), p)]
    return out


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Without what a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for i, j, q in runs:
        gone[i + q] += 1
        gone[j] -= 1
    return [w for w, k in zip(words, np.cumsum(gone[:-1]).tolist()) if not k]


def _parts(column: pa.Array) -> list[pa.Array]:
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    return [part.column(0) for part in C.slices([batch], "text")]


def periodic(p: RunParams = RunParams()):
    """Column function of a text: its runs, and its kept words joined by one space."""

    @F.arrow_udf("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    def find(text: pa.Array) -> pa.Array:
        lists, lengths, kept = [], [], []
        for part in _parts(text):
            texts = [(t or b"").split() for t in C.blobs(part)]
            for words, runs in zip(texts, runs_of_texts(texts, p)):
                lists += [(i, j - i, q) for i, j, q in runs]
                lengths.append(len(runs))
                kept.append(b" ".join(kept_words(words, runs)))
        flat = np.array(lists, np.int64).reshape(-1, 3)
        items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), items)
        return pa.StructArray.from_arrays([held, pa.array(kept, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return find


def collapse_runs(docs: DataFrame, p: RunParams = RunParams()) -> DataFrame:
    """``docs`` with ``text`` rebuilt where it has runs, and them as ``periodic_runs``
    (replacing a column of that name)."""
    text = F.col("text").cast("string")
    found = docs.withColumn("periodic_runs", periodic(p)(text))
    kept = F.when(F.size("periodic_runs.runs") > 0, F.col("periodic_runs.collapsed")).otherwise(text)
    return found.select(
        *[(kept if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns if c != "periodic_runs"],
        F.col("periodic_runs.runs").alias("periodic_runs"),
    )


def planted():
    """Column function of doc_id and text: the text in which, for one id in ten, the words
    from a place on repeat with a period. Ids and texts decide; null ids change nothing."""

    @F.arrow_udf("string")
    def plant(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        out = C.blobs(text)
        for r, d in enumerate(doc_id.to_pylist()):
            h = 1 if d is None else zlib.crc32(str(d).encode())
            if h % 10 == 0 and (words := (out[r] or b"").split()):
                n, g = len(words), h // 10
                a = g % n
                span = words[a : a + 1 + (n - a) // (3 + g % 8)]
                turns = -(-(n - a) // len(span))
                out[r] = b" ".join([*words[:a], *[w for s in repeat(span, turns) for w in s][: n - a]])
        return pa.array(out, pa.binary()).cast(pa.string())

    return plant


def _greatest(runs: str) -> Column:
    """The run with the greatest length / period, exactly; ties: smallest start, then period."""

    def better(best: Column, run: Column) -> Column:
        # runs come by start, then period, so only a greater one takes the place
        return F.when(
            best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
        ).otherwise(best)

    kind = "struct<start: bigint, length: bigint, period: bigint>"
    return F.aggregate(runs, F.lit(None).cast(kind), better)


def digest(docs: DataFrame, p: RunParams = RunParams()) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256
    of the texts with planted runs."""
    texts = K.texts_of(docs).select("doc_id", planted()("doc_id", "text").alias("text"))
    found = texts.select("doc_id", periodic(p)("text").alias("found"))
    lines = F.transform("found.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.select(
        "doc_id", F.size("found.runs").cast("long").alias("n_runs"), _greatest("found.runs").alias("best"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2(F.col("found.collapsed"), 256).alias("collapsed_sha256"),
    )
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return C.settle(told.select("doc_id", "n_runs", *best, milli, "runs_sha256", "collapsed_sha256"), "periodic_runs")
