"""Plain-loop versions of operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def id_order(doc_id):
    return (doc_id is None, doc_id or 0)


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows, radius=4):
    """(doc_id, fingerprint as hex, component) of (doc_id, text) rows."""
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def line_dedup(rows, least=10):
    """{doc_id: (lines, dropped, kept text)}."""
    held = defaultdict(set)
    split = {d: (t or "").split("\n") for d, t in rows}

    def key(line):
        return EDGE.sub("", line).translate(FOLD)

    for d, lines in split.items():
        for x in lines:
            held[key(x)].add(d)
    out = {}
    for d, lines in split.items():
        kept = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < 2 or min(held[key(x)], key=id_order) == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def text_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def nth_smallest(values, share):
    """The smallest value that at least ``share`` of all are no larger than."""
    return sorted(values)[max(math.ceil(share * len(values)) - 1, 0)]


def _covariance(near, floors):
    """Mean and covariance (divisor n) of rows, with least variances."""
    mean = near.mean(0)
    cov = sum(np.outer(r - mean, r - mean) for r in near) / len(near)
    for i, f in enumerate(floors):
        cov[i, i] += max(0.0, f * f - cov[i, i]) + f * f / 1000
    return mean, cov


def _distances(x, mean, cov):
    return np.array([(r - mean) @ np.linalg.solve(cov, r - mean) for r in x])


def concentrate(x, mean, cov, support, floors):
    d2 = _distances(x, mean, cov)
    return _covariance(x[d2 <= nth_smallest(d2.tolist(), support)], floors)


def min_determinant(x, support, floors, trial_steps, steps):
    """Centre, covariance and log determinant from four fixed starts."""
    dims = x.shape[1]
    q1, q2, q3 = (np.array([nth_smallest(x[:, i].tolist(), s) for i in range(dims)]) for s in (0.25, 0.5, 0.75))
    spread = np.maximum((q3 - q1) / 1.349, floors)
    z = (x - q2) / spread
    norm2 = (z * z).sum(1)
    made = [None, np.tanh(z), np.array([r / math.sqrt(n) if n else 0 * r for r, n in zip(z, norm2)]), z / (1 + norm2 / dims)[:, None]]
    tried = []
    for u in made:
        r = np.eye(dims)
        if u is not None:
            c = u.T @ u / len(u)
            for i in range(dims):
                for j in range(dims):
                    if i != j:
                        r[i, j] = c[i, j] / math.sqrt(c[i, i] * c[j, j]) if c[i, i] * c[j, j] > 0 else 0.0
        cov = r * np.outer(spread, spread)
        for i, f in enumerate(floors):
            cov[i, i] += max(0.0, f * f - cov[i, i]) + f * f / 1000
        mean = q2
        for _ in range(trial_steps):
            mean, cov = concentrate(x, mean, cov, support, floors)
        tried.append((np.linalg.slogdet(cov)[1], mean, cov))
    best = min(tried, key=lambda t: t[0])
    for _ in range(steps):
        mean, cov = concentrate(x, best[1], best[2], support, floors)
        now = np.linalg.slogdet(cov)[1]
        if now >= best[0] - 1e-6:
            break
        best = now, mean, cov
    return best[1], best[2], best[0]


def quality_verdicts(rows, p, cutoff, middle):
    """[(doc_id, squared distance or None, kept)] of (doc_id, text, lang, source) rows; ``cutoff``
    and ``middle`` are the chi-square's quantiles."""
    counted = []
    for d, text, lang, source in rows:
        text = text or ""
        n, chars, symbols, dup, again = text_counts(text)
        lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        marks = sum(c in "!?.,;:\"'()[]{}/\\=_~^+-@" for c in text)
        upper = sum("A" <= c <= "Z" for c in text)
        failed = n < p.least_words or 100 * again > p.most_repeat_percent * n
        w, c, k = max(n, 1), max(chars, 1), max(lines, 1)
        x = [math.log1p(n), chars / w, math.sqrt(symbols / c), math.sqrt(dup / k), math.sqrt(again / w), math.sqrt(marks / c), math.sqrt(upper / c)]
        counted.append((d, lang, source, failed, np.array(x), np.array([w, w, c, k, w, c, c], float)))
    good = [r for r in counted if not r[3]]
    site, pool = defaultdict(int), defaultdict(int)
    for r in good:
        site[r[1], r[2]] += 1
    for (lang, source), n in site.items():
        if n < p.least_group:
            pool[lang] += n
    rest = sum(n for n in pool.values() if n < p.least_group)

    def group(lang, source):
        if site[lang, source] >= p.least_group:
            return "site", lang, source
        if pool[lang] >= p.least_group:
            return "lang", lang
        return ("rest",) if rest >= p.least_group else None

    held = defaultdict(list)
    for r in good:
        held[group(r[1], r[2])].append(r)
    out = [(r[0], None, False) for r in counted if r[3]]
    for name, members in held.items():
        if name is None:
            out += [(r[0], None, True) for r in members]
            continue
        x = np.array([r[4] for r in members])
        median = np.array([nth_smallest(x[:, i].tolist(), 0.5) for i in range(x.shape[1])])
        units = np.array([r[5] for r in members])
        x = median + (x - median) * np.sqrt(units / (units + np.array(p.sizes)))
        mean, cov, _ = min_determinant(x, p.support, p.floors, p.trial_steps, p.steps)
        d2 = _distances(x, mean, cov)
        d2 /= max(1.0, nth_smallest(d2.tolist(), 0.5) / middle)
        out += [(r[0], float(d), bool(d <= cutoff)) for r, d in zip(members, d2)]
    return out


def site_rates(rows):
    """({(host, section): shrunken rate}, rate of all) of (host, section, probability) rows."""
    paths = defaultdict(list)
    for host, section, q in rows:
        paths[host, section].append(q)
    hosts = defaultdict(list)
    for (host, _), qs in paths.items():
        hosts[host] += qs
    overall = min(max(sum(q for _, _, q in rows) / len(rows), 1e-6), 1 - 1e-6)

    def weight(groups):  # (rate above, members)
        beyond, inner = [], []
        for rate, qs in groups:
            var = rate * (1 - rate)
            beyond.append((sum(qs) / len(qs) - rate) ** 2 - var / len(qs))
            inner.append(var)
        inner, beyond = sum(inner) / len(inner), sum(beyond) / len(beyond)
        return max(inner / max(beyond, inner * 1e-4) - 1, 1.0)

    w = weight([(overall, qs) for qs in hosts.values()])
    above = {h: (sum(qs) + w * overall) / (len(qs) + w) for h, qs in hosts.items()}
    w = weight([(above[h], qs) for (h, _), qs in paths.items()])
    return {(h, s): (sum(qs) + w * above[h]) / (len(qs) + w) for (h, s), qs in paths.items()}, overall


def repeats(rows, length):
    """(doc_id, bytes, removed, spans, rest) of (doc_id, text) rows; strings judged in document order."""
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: id_order(r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def best_fit(lengths, window):
    """Window of each length, longest first: the fullest that has room."""
    room, out = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            r, i = min(fits)
            room[i] -= n
        else:
            i = len(room)
            room.append(window - n)
        out.append((i, window - room[i] - n))
    return out


def nearest(vectors, every=20, top=20):
    """[(query, rank, id, score)] by the largest inner product in doubles; vectors: {id: list}."""
    out = []
    for q in sorted(vectors):
        if q % every:
            continue
        scored = []
        for v, x in vectors.items():
            if v != q and len(x) == len(vectors[q]):
                s = 0.0
                for a, b in zip(vectors[q], x):
                    s += float(np.float32(a)) * float(np.float32(b))
                scored.append((-s, v))
        out += [(q, k, v, -s) for k, (s, v) in enumerate(sorted(scored)[:top], 1)]
    return out
