"""Isolation forest (Liu, Ting, Zhou, ICDM 2008) over feature rows.

``forest_per_tick`` fits and scores each tick's services, as the live detector
does. ``pooled_forest`` fits one forest for a whole table, each tree from the small
subsample the method asks for, and scores all rows in parallel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalgraph.functions.ordered import ordered_fold
from signalgraph.functions.quantiles import window_rollup
from signalgraph.operators.rates import FEATURES
from signalgraph.params import Params
from signalgraph.sources.staging import stage


def mean_path(n: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    return np.where(
        n > 2, 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big, np.where(n == 2, 1.0, 0.0)
    )


class Forest:
    """All trees grown together, one level at a time.

    The nodes of all trees lie in one array. Node ``k`` of a tree has children
    ``2k + 1`` and ``2k + 2``. ``feature`` is -1 at leaves; ``length`` is the path
    length credited to rows ending there.
    """

    def __init__(self, samples: np.ndarray, seed: int) -> None:
        trees, n, width = samples.shape
        self.sample_size = n
        self.depth = max(1, math.ceil(math.log2(max(n, 2))))
        self.nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.full(trees * self.nodes, -1, dtype=np.int64)
        self.split = np.zeros(trees * self.nodes)
        self.length = np.zeros(trees * self.nodes)
        rng = np.random.default_rng(seed)
        rows = samples.reshape(trees * n, width)
        at = np.repeat(np.arange(trees), n) * self.nodes
        for level in range(self.depth + 1):
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            node, first, size = np.unique(at, return_index=True, return_counts=True)
            self.length[node] = level + mean_path(size)
            if level == self.depth or not len(node):
                break
            low, high = np.minimum.reduceat(rows, first, axis=0), np.maximum.reduceat(rows, first, axis=0)
            pick = np.where(high > low, rng.random(low.shape), -1.0).argmax(axis=1)
            each = np.arange(len(node))
            low, high = low[each, pick], high[each, pick]
            self.feature[node] = np.where(high > low, pick, -1)
            self.split[node] = low + rng.random(len(node)) * (high - low)
            live = self.feature[at] >= 0
            rows, at = rows[live], at[live]
            value = rows[np.arange(len(rows)), self.feature[at]]
            at = self._child(at, value)

    @classmethod
    def of(cls, trees: list, sample_size: int) -> Forest:
        """A forest of trees grown one by one on samples of one size."""
        forest = cls.__new__(cls)
        forest.sample_size = sample_size
        forest.depth = max(1, math.ceil(math.log2(max(sample_size, 2))))
        forest.nodes = 2 ** (forest.depth + 1) - 1
        for name in ("feature", "split", "length"):
            setattr(forest, name, np.concatenate([np.asarray(t[name]) for t in trees]))
        return forest

    def _child(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        root = at // self.nodes * self.nodes
        return root + 2 * (at - root) + 1 + (value > self.split[at])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Negative anomaly score of each row; lower is more unusual."""
        trees = len(self.feature) // self.nodes
        at = np.repeat(np.arange(trees)[:, None] * self.nodes, len(rows), axis=1)
        each = np.arange(len(rows))[None, :]
        for _ in range(self.depth):
            feature = self.feature[at]
            at = np.where(feature >= 0, self._child(at, rows[each, np.maximum(feature, 0)]), at)
        mean_length = self.length[at].mean(axis=0)
        return -(2.0 ** (-mean_length / max(float(mean_path(self.sample_size)), 1e-12)))


def subsamples(rows: np.ndarray, p: Params) -> np.ndarray:
    """Rows for each tree, drawn without replacement."""
    n = p.forest_subsample
    if len(rows) <= n:
        return np.broadcast_to(rows, (p.trees, *rows.shape))
    rng = np.random.default_rng(p.forest_seed)
    return rows[np.stack([rng.choice(len(rows), n, replace=False) for _ in range(p.trees)])]


def fit_and_score(rows: np.ndarray, p: Params) -> np.ndarray:
    """Decision value of each row; the ``contamination`` share is below 0."""
    raw = Forest(subsamples(rows, p), p.forest_seed).score(rows)
    return raw - np.percentile(raw, 100.0 * p.contamination)


def tick_decisions(rows: pd.DataFrame, p: Params) -> pd.DataFrame:
    """Decision value and outlier flag of each service of a tick; none if they are too few."""
    if len(rows) < p.forest_min_rows:
        return rows.iloc[:0][["tick_no", "tick", "service"]].assign(decision=0.0, is_outlier=False)
    rows = rows.sort_values(["total", "service"], ascending=[False, True])
    decision = fit_and_score(np.log1p(rows[FEATURES].to_numpy(dtype=float)), p)
    return rows[["tick_no", "tick", "service"]].assign(decision=decision, is_outlier=decision < 0)


def forest_per_tick(features: DataFrame, p: Params) -> DataFrame:
    """Decision value and outlier flag per tick and service.

    A tick's services are gathered, largest first. Ticks with too few give nothing.
    """

    def step(held: list, row: tuple):
        held.append(row)
        return ()

    def finish(held: list, key: tuple):
        if len(held) >= p.forest_min_rows:
            rows = np.array([row[3:] for row in held], dtype=float)
            for row, decision in zip(held, fit_and_score(np.log1p(rows), p).tolist()):
                yield *row[:3], decision, decision < 0

    return ordered_fold(
        features.select("tick_no", "tick", "service", *FEATURES),
        ["tick_no"],
        [F.col("total").desc(), F.col("service").asc_nulls_last()],
        list,
        step,
        "tick_no long, tick double, service string, decision double, is_outlier boolean",
        finish,
    )


def pooled_forest(features: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """One forest for all rows. Each tree draws its ``forest_subsample`` rows from the
    whole table, those with the smallest hash for that tree, and is grown in a task of
    its own; only the grown trees, a fixed number of nodes, come to the driver."""
    logged = features.select(*keys, *[F.log1p(c).alias(c) for c in FEATURES])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in logged.select(*keys).schema)
    total, size = logged.count(), p.forest_subsample
    if total < p.forest_min_rows:
        return logged.limit(0).select(*keys, F.lit(0.0).alias("decision"), F.lit(False).alias("is_outlier"))
    # twice as many candidates as are needed; a tree is short of rows with a chance below 1e-20
    likely = F.lit(int(min(1.0, 2.0 * size / total) * (1 << 30)))
    lots = F.transform(
        F.sequence(F.lit(0), F.lit(p.trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64(F.lit(p.forest_seed), t, *keys), F.lit(1 << 30)).alias("luck")),
    )
    drawn = logged.withColumn("lot", F.explode(F.filter(lots, lambda x: x["luck"] < likely))).select("lot.*", *keys, *FEATURES)
    order = Window.partitionBy("tree").orderBy("luck", *keys)
    samples = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= min(size, total))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values("place")[FEATURES].to_numpy(dtype=float)
        f = Forest(rows[None], p.forest_seed + tree)
        return pd.DataFrame({"tree": [tree], "feature": [f.feature], "split": [f.split], "length": [f.length]})

    grown = samples.groupBy("tree").applyInPandas(grow, "tree int, feature array<long>, split array<double>, length array<double>")
    forest = Forest.of(grown.orderBy("tree").collect(), min(size, total))
    shared = features.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for pdf in batches:
            yield pdf[keys].assign(raw=shared.value.score(pdf[FEATURES].to_numpy(dtype=float)))

    scored = stage(logged.mapInPandas(run, f"{schema}, raw double"), "forest_scores")
    one_window = scored.withColumn("pane", F.lit(0).cast("bigint"))
    offset = window_rollup(one_window, [], "raw", {}, {"offset": p.contamination}).first()["offset"]
    return scored.select(
        *keys, (F.col("raw") - F.lit(offset)).alias("decision"), (F.col("raw") < F.lit(offset)).alias("is_outlier")
    )
