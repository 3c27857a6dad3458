"""Approximate nearest neighbours by largest inner product: a pruned directed graph per shard.

Distinct vectors are dealt by hash into shards of about ``shard_vectors``. A task
builds one shard's graph (Subramanya et al., 2019): greedy searches from the middle
propose neighbours for each vector, and robust pruning keeps a neighbour only if no
kept one is ``alpha`` times nearer to it, first strictly, then relaxed, which leaves
some long edges. Inner products become distances by one more coordinate that gives
all vectors of a shard the same norm. Graphs are a settled table; a beam search
answers a block of queries on one shard; the nearest over all shards are ranked by
their inner products on the original vectors, summed in double precision in the order
of components. A shard no larger than the beam is searched whole.

Every vector is indexed. Equal vectors are one vertex that holds the ``top + 1``
smallest ids, which is all that a result can need of them.

Vectors that are null, empty, zero or hold null or non-finite components take no part,
on either side, nor do rows without an id. Vectors meet only those of their own
length. Repeated rows count once for each (id, vector). Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalgraph.llm import common as C


@dataclass(frozen=True)
class GraphParams:
    top: int = 20
    shard_vectors: int = 8_192
    query_block: int = 2_048
    degree: int = 32
    build_beam: int = 64
    search_beam: int = 96
    alpha: float = 1.2
    seed: int = 7


class Graph:
    """Vectors (float32, equal norms) and out-neighbours (-1: none)."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, start: int):
        self.x, self.edges, self.start = vectors, edges, start

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search for each row of ``q``: vertices and squared distances,
        nearest first; -1 and infinity where fewer were met. Every vertex of the final
        beam has been expanded."""
        n, rows = len(self.x), np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        ids = np.full((len(q), beam), n)
        far = np.full((len(q), beam), np.inf, np.float32)
        done = np.ones((len(q), beam), bool)
        ids[:, 0], far[:, 0], done[:, 0] = self.start, ((q - self.x[self.start]) ** 2).sum(1), False
        seen[:, self.start] = seen[:, n] = True
        live = rows
        while len(live):
            step = np.where(done[live], np.inf, far[live]).argmin(1)
            done[live, step] = True
            near = self.edges[ids[live, step]]
            near = np.where(near < 0, n, near)
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            gap = self.x[np.where(fresh, near, 0)] - q[live][:, None, :]
            d = np.where(fresh, np.einsum("ijk,ijk->ij", gap, gap), np.inf).astype(np.float32)
            every = np.concatenate([far[live], d], 1)
            order = np.argpartition(every, beam - 1, axis=1)[:, :beam]
            far[live] = np.take_along_axis(every, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), order, 1) | np.isinf(far[live])
            live = live[~done[live].all(1)]
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        return np.where(np.isinf(far), -1, np.take_along_axis(ids, order, 1)), far


def robust_prune(x: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of ``points``, at most ``degree`` of its candidates (``found``, -1: none):
    the nearest first, then only those not ``alpha`` times nearer to a kept one."""
    valid = (found >= 0) & (found != points[:, None])
    cand = x[np.where(valid, found, 0)]
    gap = cand - x[points][:, None, :]
    to_point = np.where(valid, np.einsum("ijk,ijk->ij", gap, gap), np.inf)
    square = np.einsum("ijk,ijk->ij", cand, cand)
    between = np.maximum(square[:, :, None] + square[:, None, :] - 2 * cand @ cand.transpose(0, 2, 1), 0)
    rows = np.arange(len(points))
    kept = np.full((len(points), degree), -1)
    open_ = to_point.copy()
    for k in range(degree):
        pick = open_.argmin(1)
        some = np.isfinite(open_[rows, pick])
        if not some.any():
            break
        kept[some, k] = found[some, pick[some]]
        beaten = alpha * alpha * between[rows, pick] <= to_point
        open_[beaten] = np.inf
        open_[rows, pick] = np.inf
    return kept


def build_graph(x: np.ndarray, p: GraphParams, batch: int = 256) -> Graph:
    """Two passes over the vectors, the second with relaxed pruning."""
    n, rng = len(x), np.random.default_rng(p.seed)
    middle = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    edges = np.full((n, p.degree), -1)
    width = min(p.degree // 2, n - 1)
    if width > 0:
        edges[:, :width] = rng.integers(0, n, (n, width))
    graph = Graph(x, edges, middle)
    for alpha in (1.0, p.alpha):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            points = order[k : k + batch]
            met, _ = graph.search(x[points], min(p.build_beam, n))
            kept = robust_prune(x, points, np.concatenate([met, edges[points]], 1), p.degree, alpha)
            edges[points] = kept
            _add_back(x, edges, points, kept, p.degree, alpha)
    return graph


def _add_back(x: np.ndarray, edges: np.ndarray, points: np.ndarray, kept: np.ndarray, degree: int, alpha: float) -> None:
    """Edges from the neighbours back; a vertex with too many is pruned again."""
    src = kept[kept >= 0]
    dst = np.repeat(points, (kept >= 0).sum(1))
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    vertices, first, size = np.unique(src, return_index=True, return_counts=True)
    wide = np.full((len(vertices), int(size.max(initial=0))), -1)
    wide[np.repeat(np.arange(len(vertices)), size), np.arange(len(src)) - np.repeat(first, size)] = dst
    both = np.concatenate([edges[vertices], wide], 1)
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # an edge that is already there
    count = (both >= 0).sum(1)
    fits = count <= degree
    edges[vertices[fits]] = -np.sort(-both[fits], axis=1)[:, :degree]
    for k in range(0, int((~fits).sum()), 256):
        some = np.flatnonzero(~fits)[k : k + 256]
        edges[vertices[some]] = robust_prune(x, vertices[some], both[some], degree, alpha)


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, v (array<float>), dim."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<float>").alias("v"))
    return rows.filter("id is not null and v is not null").filter(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _level(x: np.ndarray) -> np.ndarray:
    """One more coordinate that makes all norms equal: distance order is then that of inner products."""
    square = (x.astype(np.float64) ** 2).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None].astype(np.float32)], 1)


def index(vectors: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """dim, shard, n, vectors, ids, edges, start: a row for each shard, lazily."""
    w = Window.partitionBy("v").orderBy("id")
    first = vectors.distinct().withColumn("place", F.row_number().over(w)).filter(F.col("place") <= p.top + 1)
    vertices = C.settle(first.groupBy("v").agg(F.first("dim").alias("dim"), F.sort_array(F.collect_list("id")).alias("ids")), "vertices")
    shards = max(1, math.ceil(vertices.count() / p.shard_vectors))
    dealt = vertices.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        dim = rows.column("dim")[0].as_py()
        x = _matrix(rows.column("v"), dim)
        order = np.lexsort(x.T)  # the same graph whatever order the rows came in
        x = x[order]
        graph = build_graph(_level(x), p)
        ids = rows.column("ids").combine_chunks().take(pa.array(order))
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": rows.column("shard")[:1].cast(pa.int32()), "n": pa.array([len(x)], pa.int32()),
            "vectors": pa.array([x.tobytes()], pa.binary()), "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "edges": pa.array([graph.edges.astype(np.int32).tobytes()], pa.binary()), "start": pa.array([graph.start], pa.int32()),
        })

    fields = "dim int, shard int, n int, vectors binary, ids array<array<long>>, edges binary, start int"
    return dealt.groupBy("dim", "shard").applyInArrow(build, fields)


def search(queries: DataFrame, graphs: DataFrame, p: GraphParams = GraphParams()) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries``: id, v, dim; ``graphs``: settled ``index``."""
    blocks = max(1, math.ceil(queries.count() / p.query_block))
    shards = graphs.select(F.col("dim").alias("of_dim"), F.col("shard").alias("at"))
    asked = queries.distinct().withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = asked.join(shards, F.col("dim") == F.col("of_dim"))  # every query goes to every shard of its length
    parts = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    top, beam = p.top, p.search_beam
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def answer(asking: pa.Table, part: pa.Table) -> pa.Table:
        if not asking.num_rows or not part.num_rows:
            return empty
        dim, n = part.column("dim")[0].as_py(), part.column("n")[0].as_py()
        x = np.frombuffer(part.column("vectors")[0].as_py(), np.float32).reshape(n, dim)
        level = _level(x)
        edges = np.frombuffer(part.column("edges")[0].as_py(), np.int32).reshape(n, -1)
        ids = part.column("ids")[0].as_py()
        graph = Graph(level, edges, part.column("start")[0].as_py())
        who = asking.column("id").to_numpy()
        q = _matrix(asking.column("v"), dim)
        out_q, out_v, out_s = [], [], []
        for k in range(0, len(q), 256):
            some = q[k : k + 256]
            # the length of a query doesn't change the order of its inner products; scale it to the vectors'
            scale = np.sqrt((level[:1].astype(np.float64) ** 2).sum()) / np.sqrt((some.astype(np.float64) ** 2).sum(1, keepdims=True))
            flat = np.concatenate([some * scale, np.zeros((len(some), 1))], 1).astype(np.float32)
            found = np.tile(np.arange(n), (len(some), 1)) if n <= beam else graph.search(flat, beam)[0]
            score = inner_products(some, x[np.where(found < 0, 0, found)])
            score[found < 0] = -np.inf
            order = np.argsort(-score, axis=1, kind="stable")
            for r, one in enumerate(who[k : k + 256].tolist()):
                # vertices down to the score of the one that fills the list, whole ties included
                got = []
                for c in order[r].tolist():
                    if found[r, c] < 0 or (len(got) > top and score[r, c] < got[-1][0]):
                        break
                    got.extend((float(score[r, c]), v) for v in ids[found[r, c]] if v != one)
                got.sort(key=lambda e: (-e[0], e[1]))
                for s, v in got[:top]:
                    out_q.append(one)
                    out_v.append(v)
                    out_s.append(s)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = (
        asked.groupBy("of_dim", "at", "block")
        .cogroup(parts.groupBy("dim", "shard", "block"))
        .applyInArrow(answer, "query_id long, vec_id long, score double")
    )
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of rows of ``q`` with rows of ``x`` (query, candidate, component), in doubles, one component after the other."""
    total = np.zeros(x.shape[:2])
    for j in range(x.shape[2]):
        total += q[:, None, j].astype(np.float64) * x[:, :, j].astype(np.float64)
    return total


def nearest(vectors: DataFrame, every: int = 20, p: GraphParams = GraphParams()) -> DataFrame:
    """The nearest of each vector whose id is divisible by ``every``, among all others."""
    rows = usable(vectors)
    graphs = C.settle(index(rows, p), "graphs")
    return search(rows.filter(F.col("id") % every == 0), graphs, p)
