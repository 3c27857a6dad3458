"""Quality and toxicity by hierarchical empirical Bayes over documents, paths and hosts.

A classifier (logistic regression over those hashed features of whole texts that tell
the classes apart) gives each document evidence. Soft counts of it are summed by path (host and section) and by
host; beta priors shrink them: a path towards its host, a host towards all documents.
How strongly comes from the data: the prior's weight is fitted by the method of
moments to the spread of the rates beyond what their counts explain, so a sparse site
is taken for what sites are in general, and a large one speaks for itself. A document's
posterior puts its own evidence on the odds of its path.

In ``documents`` the host is ``source`` and the section is ``lang``. The classifier is
fitted on at most ``sample_rows`` labelled documents (those with the smallest hash of
their id; the documented bound); everything else covers all rows: counts are grouped
sums with combining on the map side, and a document meets its path in an equi-join.

Null texts have no words and are judged by the intercept and their site. Null sources
and languages are sites of their own. Rows come back each, repeated ones too; labels
of a document given twice count twice in the sample. Without any label of a kind the
posterior is null and ``kept`` true. Columns other than ``doc_id``, ``text``, ``source``
and ``lang`` (``doc_id``, ``quality``, ``toxic`` of labels) are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C

EDGES = b".,;:!?\"'()[]{}<>|#*$%&=_~^+-/\\@"
WORDS_HELD = 700_000


@dataclass(frozen=True)
class SiteParams:
    buckets: int = 1 << 18
    sample_rows: int = 12_000
    rounds: int = 60
    rate: float = 0.5
    penalty: float = 1e-4
    least_docs: int = 3  # of the sample that a feature must be in
    least_z: float = 3.5  # how far from chance it must be
    least_quality: float = 0.1  # posterior below which a document goes
    most_toxic: float = 0.5  # posterior above which it goes


class Features:
    """Hashed features of a text: its distinct words without punctuation at their
    ends, and how often its words end in each kind of punctuation, are in capitals,
    or repeat the word before (in steps of powers of two)."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def bucket(self, name: bytes) -> int:
        return xxhash.xxh3_64_intdigest(name) % self.buckets

    def _split(self, word: bytes) -> tuple[int, bytes, bool]:
        core = word.strip(EDGES)
        return self.bucket(core.lower()), word[len(word.rstrip(EDGES)) :][:4], core.isupper() and len(core) > 1

    def of(self, text: bytes) -> list[int]:
        words = text.split()
        if not words:
            return []
        times = Counter(words)
        known = self.known
        if len(known) > WORDS_HELD:
            known.clear()
        ends: Counter = Counter()
        upper = 0
        found = set()
        for w, n in times.items():
            got = known.get(w)
            if got is None:
                got = known[w] = self._split(w)
            found.add(got[0])
            if got[1]:
                ends[got[1]] += n
            if got[2]:
                upper += n
        again = sum(map(bytes.__eq__, words, words[1:]))
        for kind, n in (*ends.items(), (b"\x00upper", upper), (b"\x00again", again)):
            if n:
                share = int(-math.log2(n / len(words)))
                found.update(self.bucket(b"\x00%b %d" % (kind, k)) for k in range(min(share, 8), 9))
        return list(found)


def _texts(docs: DataFrame) -> DataFrame:
    def name(c: str) -> Column:
        return F.to_json(F.struct(F.col(c).cast("string").alias(c))) if c in docs.columns else F.lit("{}")

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        name("source").alias("host"), name("lang").alias("section"),
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, p: SiteParams) -> list:
    """(features, quality, toxic) of at most ``sample_rows`` labelled documents, however
    often an id occurs among them."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null")
        .orderBy(F.xxhash64("doc_id"), "quality", "toxic")
        .limit(p.sample_rows)
    )
    rows = _texts(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    buckets = p.buckets

    def run(batches: Iterator[pa.RecordBatch]):
        of = Features(buckets).of
        for part in C.slices(batches, "text"):
            yield {
                "doc_id": part.column("doc_id"),
                "features": [np.array(of(t or b""), "<i4").tobytes() for t in C.blobs(part.column("text"))],
                "quality": part.column("quality"),
                "toxic": part.column("toxic"),
            }

    found = C.arrow_map(rows, run, "doc_id long, features binary, quality int, toxic int")
    return found.orderBy(F.xxhash64("doc_id"), "quality", "toxic", F.xxhash64("features")).limit(p.sample_rows).collect()


def chosen_features(doc: np.ndarray, at: np.ndarray, target: np.ndarray, p: SiteParams) -> np.ndarray:
    """Which buckets tell the classes apart: signed roots of the likelihood ratio of
    their counts, ``least_z`` or more away from chance."""
    with_it = np.bincount(at, minlength=p.buckets).astype(float)
    hits = np.bincount(at, weights=target[doc], minlength=p.buckets)
    n, pos = len(target), target.sum()

    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    g2 = np.zeros(p.buckets)
    for k, total in ((hits, pos), (with_it - hits, n - pos)):
        g2 += part(k, with_it * total / n) + part(total - k, (n - with_it) * total / n)
    return (with_it >= p.least_docs) & (2 * g2 >= p.least_z**2)


def fit(features: list[np.ndarray], target: np.ndarray, p: SiteParams) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on the chosen features (adaptive
    gradient steps over the whole sample)."""
    doc = np.repeat(np.arange(len(features)), [len(f) for f in features])
    at = np.concatenate(features) if len(doc) else np.empty(0, np.int64)
    use = chosen_features(doc, at, target, p)
    doc, at = doc[use[at]], at[use[at]]
    w, g2 = np.zeros(p.buckets), np.full(p.buckets, 1e-8)
    rate = min(max(target.mean(), 1e-4), 1 - 1e-4)
    b, b2 = math.log(rate / (1 - rate)), 1e-8
    for _ in range(p.rounds):
        z = np.bincount(doc, weights=w[at], minlength=len(features)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(at, weights=err[doc], minlength=p.buckets) / len(features) + p.penalty * w
        g2 += g * g
        w -= p.rate * g / np.sqrt(g2)
        gb = err.mean()
        b2 += gb * gb
        b -= p.rate * gb / math.sqrt(b2)
    # one more line through the scores sets the odds to those of the sample
    slope, shift = _calibrate(np.bincount(doc, weights=w[at], minlength=len(features)), target)
    return w * slope, shift


def _calibrate(z: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift, by Newton steps with his smoothed targets."""
    pos, neg = target.sum(), (1 - target).sum()
    t = np.where(target > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, spread = z.mean(), z.std() + 1e-9
    x = np.stack([(z - mean) / spread, np.ones(len(z))], 1)
    c = np.array([1.0, math.log((pos + 1) / (neg + 1))])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        c = c - np.clip(np.linalg.solve(h, x.T @ (q - t)), -2, 2)
    return c[0] / spread, c[1] - c[0] * mean / spread


def evidence(docs: DataFrame, models: list[tuple[np.ndarray, float] | None], buckets: int) -> DataFrame:
    """doc_id, host, section and the log odds of each model (null without one)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # buckets x 8 bytes for each model, whatever the input

    def run(batches: Iterator[pa.RecordBatch]):
        of = Features(buckets).of
        weights = shared.value
        for part in C.slices(batches, "text"):
            scores: list[list] = [[], []]
            for text in C.blobs(part.column("text")):
                at = of(text or b"")
                for k, model in enumerate(weights):
                    scores[k].append(None if model is None else float(model[0][at].sum() + model[1]))
            yield {c: part.column(c) for c in ("doc_id", "host", "section")} | {"quality": scores[0], "toxic": scores[1]}

    return C.arrow_map(_texts(docs), run, "doc_id long, host string, section string, quality double, toxic double")


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def prior_weight(sites: DataFrame, rate: str, total: str, count: str) -> float:
    """Weight (as a number of documents) of the prior ``rate`` of sites with ``total``
    out of ``count``: by moments of their spread beyond the binomial's."""
    off = F.col(total) / F.col(count) - F.col(rate)
    var = F.col(rate) * (1 - F.col(rate))
    n, spread, inner, noise = sites.agg(
        F.count(F.lit(1)), F.avg(off * off), F.avg(var), F.avg(var / F.col(count))
    ).first()
    if not n or not inner:
        return 1.0
    beyond = max(spread - noise, inner * 1e-4)
    return max(inner / beyond - 1, 1.0)


def site_posteriors(scored: DataFrame, kind: str) -> tuple[DataFrame, float]:
    """host, section and the shrunken rate of ``kind`` at that path; the rate of all documents."""
    paths = C.settle(
        scored.groupBy("host", "section").agg(F.count(F.lit(1)).alias("n"), F.sum(_probability(F.col(kind))).alias("hits")), "paths"
    )
    hosts = C.settle(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("hits").alias("host_hits")), "hosts")
    n, hits = hosts.agg(F.sum("host_n"), F.sum("host_hits")).first()
    overall = min(max((hits or 0.0) / max(n or 0, 1), 1e-6), 1 - 1e-6)
    hosts = hosts.withColumn("overall", F.lit(overall))
    weight = prior_weight(hosts, "overall", "host_hits", "host_n")
    hosts = hosts.withColumn("host_rate", (F.col("host_hits") + weight * overall) / (F.col("host_n") + weight))
    both = C.settle(paths.join(hosts, "host"), "sites")
    weight = prior_weight(both, "host_rate", "hits", "n")
    rate = (F.col("hits") + weight * F.col("host_rate")) / (F.col("n") + weight)
    return both.select("host", "section", rate.alias(f"{kind}_site")), overall


def _log_odds(rate: Column) -> Column:
    return F.log(rate / (1 - rate))


def judged(docs: DataFrame, labels: DataFrame, p: SiteParams = SiteParams()) -> DataFrame:
    """doc_id, host, section, quality_site, toxic_site, quality, toxic (posteriors), kept."""
    sample = labelled_sample(docs, labels, p)
    models: list = []
    for kind in ("quality", "toxic"):
        rows = [r for r in sample if r[kind] in (0, 1)]
        target = np.array([r[kind] for r in rows], float)
        both = len(rows) and 0 < target.sum() < len(rows)
        models.append(fit([np.frombuffer(r["features"], "<i4") for r in rows], target, p) if both else None)
    scored = C.settle(evidence(docs, models, p.buckets), "evidence")
    out = scored
    for kind, model in zip(("quality", "toxic"), models):
        if model is None:
            out = out.withColumn(f"{kind}_site", F.lit(None).cast("double"))
            continue
        sites, overall = site_posteriors(scored, kind)
        out = out.join(sites, ["host", "section"])
        # the classifier's odds hold the overall rate already; the path's takes its place
        odds = F.col(kind) - math.log(overall / (1 - overall)) + _log_odds(F.col(f"{kind}_site"))
        out = out.withColumn(kind, _probability(odds))
    good = F.coalesce(F.col("quality") >= p.least_quality, F.lit(True)) & F.coalesce(F.col("toxic") <= p.most_toxic, F.lit(True))
    return out.select("doc_id", "host", "section", "quality_site", "toxic_site", "quality", "toxic", good.alias("kept"))
