"""Whitens embeddings along the leading components of their covariance.

Entries c become whole numbers x = floor(``scale`` * c) + ``offset``, so that counts and
sums are exact. The covariance V of all vectors is never formed; with Y the centred rows,

1. each task reduces its rows of Y block by block to a triangle R (QR of the triangle so
   far over the next rows), and triangles are joined in rounds of a bounded number until one
   is left, V = R'R / n. A round is a settled table, so a lost executor costs a task;
2. Householder reflections make R bidiagonal;
3. dqds (differential quotient-difference with shifts) finds the squared singular values
   from the bidiagonal entries, without subtractions and so to high relative accuracy;
4. for each, the two triangular factorisations of the shifted tridiagonal L D L', from the
   top and from the bottom, are joined (twisted) where the pivot is least; that gives the
   vector in one sweep of products. Vectors of values closer than ``CLOSE`` are made
   orthogonal to each other. The reflections take them back to the directions of V.

A driver holds one triangle (dims x dims) and the directions (components x dims), whatever
the number of rows. Whitened rows are checked in one more pass: their covariance, centred
block by block and merged in the same rounds, against the identity.

Vectors that are null, empty or hold null or non-finite entries, or entries beyond 2^40, are
left out, and so are vectors of another length than most rows have (ties: the longer), as
they are no points of that space. Repeated rows and null ids come back each. Components
without variance (fewer rows than dimensions, constant entries) have a null ``whitened``;
``explained`` is null where nothing varies, ``identity_error`` where no component does. A
``deviation`` beyond a long is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C

EPS = np.finfo(float).eps
#: Values whose relative distance is below this have their vectors made orthogonal.
CLOSE = 1e-3
#: Largest entry of a vector.
LARGEST = 2.0**40
#: Rows that a task handles at a time.
ROWS = 4096
#: Bytes of triangles that one task joins.
JOIN_BYTES = 64_000_000


@dataclass(frozen=True)
class WhitenParams:
    components: int = 32
    scale: int = 64
    offset: int = 1_000_000


# --- singular values and vectors of a triangle -------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of U'RW, and the unit vectors of the reflections in W."""
    a = np.array(r, float)
    n = len(a)
    right = []
    for k in range(n):
        w = _reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= np.outer(2 * w, w @ a[k:, k:])
        w = _reflector(a[k, k + 1 :]) if k < n - 2 else None
        right.append(w)
        if w is not None:
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ w, 2 * w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """Unit w so that x - 2 w (w.x) has zeros after its first entry."""
    size = np.linalg.norm(x)
    if len(x) < 2 or size == 0 or not np.any(x[1:]):
        return None
    w = x.copy()
    w[0] += math.copysign(size, w[0])
    return w / np.linalg.norm(w)


def back(right: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """W z: a vector of the bidiagonal matrix as one of the triangle."""
    v = z.copy()
    for k in range(len(right) - 1, -1, -1):
        w = right[k]
        if w is not None:
            v[k + 1 :] -= 2 * w * (w @ v[k + 1 :])
    return v


def dqds(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Squared singular values of the bidiagonal matrix with diagonal a, superdiagonal b."""
    q, e = (a * a).tolist(), (b * b).tolist()
    if len(q) > 1 and q[0] < q[-1]:  # converges from the small end
        q, e = q[::-1], e[::-1]
    tol = (10 * EPS) ** 2
    found, taken, shift = [], 0.0, 0.0
    for _ in range(200 * len(q) + 200):
        while q and (len(q) == 1 or e[-1] <= tol * (taken + q[-1])):
            found.append(taken + q.pop())
            if e:
                e.pop()
            shift = 0.0
        if not q:
            return found
        for attempt in range(5):
            step = _dqds_step(q, e, shift)
            if step[2] >= 0:
                break
            late = step[3]
            shift = max(0.0, shift + step[2]) if late and attempt < 2 else 0.25 * shift if attempt < 3 else 0.0
        q, e, least, _ = step
        taken += shift
        shift = _next_shift(q, e, least)
    raise ArithmeticError("dqds has not converged")


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One transform: the new array, its least d, and whether only the last d is negative."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return new_q, new_e, d, False
        s = d + e[i]
        new_q[i] = s
        if s > 0:
            t = q[i + 1] / s
            new_e[i] = e[i] * t
            d = d * t - shift
        else:  # the matrix falls into two parts here
            d = q[i + 1] - shift
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least, True


def _next_shift(q: list[float], e: list[float], least: float) -> float:
    """Least eigenvalue of the last two rows where the end is settling, else a share of the least d."""
    if len(q) < 2 or least <= 0:
        return 0.0
    if q[-1] > 4 * least:
        return 0.25 * least
    mid, off = q[-2] + q[-1] + e[-1], q[-2] * q[-1]
    root = math.sqrt(max(0.0, mid * mid - 4 * off))
    return min(2 * off / (mid + root) * (1 - 1e-3 * min(1.0, e[-1] / (q[-1] or 1.0))) if mid + root > 0 else 0.0, least)


def twisted(a: np.ndarray, b: np.ndarray, value: float, known: list[np.ndarray], refine: bool) -> np.ndarray:
    """The unit right vector of the bidiagonal matrix for a squared singular value, at
    right angles to the ``known`` ones of nearly the same value. ``refine`` corrects the
    value by the vector found, for values that stand alone."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    tiny = EPS * EPS * max(value, float(np.max(np.abs(a))) ** 2, 1e-280)
    a = np.where(np.abs(a) < math.sqrt(tiny), math.sqrt(tiny), a)
    d, low = (a * a).tolist(), (b / a[:-1]).tolist()
    for _ in range(4 if refine else 1):
        down, s, up, p = [0.0] * (n - 1), [0.0] * n, [0.0] * (n - 1), [0.0] * n
        s[0] = -value
        for i in range(n - 1):
            pivot = s[i] + d[i] or tiny
            down[i] = d[i] * low[i] / pivot
            s[i + 1] = down[i] * low[i] * s[i] - value
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            pivot = d[i] * low[i] * low[i] + p[i + 1] or tiny
            t = d[i] / pivot
            up[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        gamma = np.abs(np.array(s) + np.array(p) + value)
        twists = np.argsort(gamma, kind="stable")
        z = _from_twist(int(twists[0]), down, up)
        off = float((s[twists[0]] + p[twists[0]] + value)) * float(z[twists[0]]) ** 2
        if abs(off) <= 4 * EPS * value:
            break
        value += off
    if not known:
        return z
    # equal to the last digits: other twists give other vectors of the same space
    best, best_left = z, -1.0
    for at in twists.tolist():
        z = _from_twist(at, down, up)
        left = 1.0
        for _ in range(3):
            for x in known:
                z = z - x * (x @ z)
            size = float(np.linalg.norm(z))
            left *= size
            z = z / (size or 1.0)
        if left > best_left:
            best, best_left = z, left
        if left > 0.1:
            break
    return best


def _from_twist(at: int, down: list[float], up: list[float]) -> np.ndarray:
    n = len(down) + 1
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -up[i] * z[i]
    z[~np.isfinite(z)] = 0.0
    return z / np.linalg.norm(z)


def singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squared singular values of a triangle, falling, and their right
    vectors as rows."""
    a, b, right = bidiagonal(r)
    n = len(a)
    norm = max(float(np.max(np.abs(a), initial=0.0)), float(np.max(np.abs(b), initial=0.0)))
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * np.sqrt(np.abs(a[:-1] * a[1:])) + EPS * EPS * norm) + 1).tolist(), n]
    values = []  # (squared value, block)
    for i, j in zip(cuts, cuts[1:]):
        values += [(v, i, j) for v in dqds(a[i:j], b[i : j - 1])]
    values = sorted(values, key=lambda v: (-v[0], v[1]))[:most]
    vectors = np.zeros((len(values), n))
    for k, (value, i, j) in enumerate(values):
        alike = [x for x, (v, at, _) in enumerate(values) if x != k and at == i and abs(v - value) <= CLOSE * max(v, value)]
        known = [vectors[x][i:j] for x in alike if x < k]
        vectors[k][i:j] = twisted(a[i:j], b[i : j - 1], value, known, not alike)
    out = np.array([back(right, z) for z in vectors]).reshape(len(values), n)
    for v in out:
        v /= np.linalg.norm(v) or 1.0
        v *= math.copysign(1.0, v[np.argmax(np.abs(v))])
    return np.array([v for v, _, _ in values]), out


# --- over the rows -------------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """Count and sums of the whole numbers, and what follows from their covariance."""

    n: int
    sums: list[int]
    exact_long: bool  # n * x - sums fits a long
    values: np.ndarray  # of the covariance, falling
    directions: np.ndarray
    trace: float

    @property
    def varied(self) -> int:
        """How many components have variance."""
        if not self.trace > 0:
            return 0
        return int(np.sum(self.values > EPS * len(self.sums) * self.values[0]))


def usable(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, vector (array of doubles): rows with finite entries."""
    rows = embeddings.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("vector")
    )
    fits = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return rows.filter((F.size("vector") > 0) & fits)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def whole(vectors: np.ndarray, p: WhitenParams) -> np.ndarray:
    return np.floor(vectors * p.scale).astype(np.int64) + p.offset


def totals(rows: DataFrame, dims: int, p: WhitenParams) -> tuple[int, list[int], int]:
    """Count, sums per dimension and largest |x|, all exact."""

    def run(batches):
        for part in _blocks(batches):
            x = whole(_matrix(part.column("vector"), dims), p)
            yield {"at": np.arange(dims + 2), "total": [*x.sum(0).tolist(), len(x), 0], "most": [*[0] * (dims + 1), int(np.abs(x).max())]}

    sums = C.arrow_map(rows, run, "at long, total long, most long").groupBy("at").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("most").alias("most")
    )
    told = {r["at"]: r for r in sums.collect()}  # a row per dimension
    return int(told[dims]["total"]), [int(told[k]["total"]) for k in range(dims)], int(told[dims + 1]["most"])


def deviations(x: np.ndarray, fit: Fit) -> np.ndarray:
    """n * x - sums, exact: as longs, or as Python's numbers where these don't fit."""
    if fit.exact_long:
        return x * fit.n - np.array(fit.sums, np.int64)
    return x.astype(object) * fit.n - np.array(fit.sums, object)


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    return deviations(x, fit).astype(float) / fit.n


def joined(parts: DataFrame, join: Callable[[list[bytes]], bytes], fan: int, name: str) -> bytes | None:
    """The bodies of ``parts`` (k, body) made one in rounds that join ``fan`` of them."""
    rows = C.settle(parts, name)

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("k").to_numpy())
        bodies = table.column("body").take(pa.array(order)).to_pylist()
        k = table.column("up")[0].as_py()
        return pa.table({"k": pa.array([k], pa.int64()), "body": pa.array([join(bodies)], pa.binary())})

    while (top := rows.agg(F.max("k")).first()[0]) is not None:
        if top == 0:
            return bytes(rows.first()["body"])
        up = rows.withColumn("up", F.expr(f"k div {fan}")).groupBy("up").applyInArrow(run, "k long, body binary")
        after = C.settle(up, name)
        C.discard(rows)
        rows = after
    return None


def _told(body: np.ndarray) -> dict:
    return {"k": [TaskContext.get().partitionId()], "body": [np.ascontiguousarray(body).tobytes()]}


def triangle(rows: DataFrame, fit: Fit, p: WhitenParams) -> np.ndarray:
    """R with R'R = Y'Y for the centred rows Y."""
    dims = len(fit.sums)

    def reduce(batches):
        r = np.zeros((0, dims))
        for part in _blocks(batches):
            y = centred(whole(_matrix(part.column("vector"), dims), p), fit)
            r = np.linalg.qr(np.vstack([r, y]), mode="r")
        if len(r):
            yield _told(np.vstack([r, np.zeros((dims - len(r), dims))]))

    def join(bodies: list[bytes]) -> bytes:
        stack = np.vstack([np.frombuffer(b).reshape(dims, dims) for b in bodies])
        return np.linalg.qr(stack, mode="r").tobytes()

    fan = max(2, min(64, JOIN_BYTES // (8 * dims * dims)))
    return np.frombuffer(joined(C.arrow_map(rows, reduce, "k long, body binary"), join, fan, "triangles")).reshape(dims, dims)


def fitted(rows: DataFrame, dims: int, p: WhitenParams = WhitenParams()) -> Fit:
    """``rows`` are (vec_id, vector) of one length."""
    n, sums, most = totals(rows, dims, p)
    start = Fit(n, sums, 2 * n * most < 2**62, np.zeros(0), np.zeros((0, dims)), 0.0)
    r = triangle(rows, start, p)
    values, directions = singular(r, min(p.components, dims))
    return Fit(n, sums, start.exact_long, values / n, directions, float(np.sum(r * r)) / n)


def projected(x: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened coordinates along the components that have variance."""
    k = fit.varied
    return centred(x, fit) @ fit.directions[:k].T / np.sqrt(fit.values[:k])


def identity_error(rows: DataFrame, fit: Fit, p: WhitenParams) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    dims, k = len(fit.sums), fit.varied
    if not k:
        return None

    def merge(a, b):
        """Count, mean and centred products of two blocks as those of one."""
        n = a[0] + b[0]
        off = b[1] - a[1]
        return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)

    def pack(block) -> np.ndarray:
        return np.concatenate([[block[0]], block[1], block[2].ravel()])

    def unpack(body: bytes):
        flat = np.frombuffer(body)
        return flat[0], flat[1 : k + 1], flat[k + 1 :].reshape(k, k)

    def reduce(batches):
        whole_block = None
        for part in _blocks(batches):
            w = projected(whole(_matrix(part.column("vector"), dims), p), fit)
            mean = w.mean(0)
            block = (float(len(w)), mean, (w - mean).T @ (w - mean))
            whole_block = merge(whole_block, block) if whole_block else block
        if whole_block:
            yield _told(pack(whole_block))

    def join(bodies: list[bytes]) -> bytes:
        block = unpack(bodies[0])
        for b in bodies[1:]:
            block = merge(block, unpack(b))
        return pack(block).tobytes()

    n, _, products = unpack(joined(C.arrow_map(rows, reduce, "k long, body binary"), join, 64, "products"))
    return float(np.abs(products / n - np.eye(k)).max())


def common_length(rows: DataFrame) -> int | None:
    """The length that most vectors have (ties: the longer)."""
    counts = rows.groupBy(F.size("vector").alias("dims")).count()
    first = counts.orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    return first["dims"] if first else None


def whitened(embeddings: DataFrame, p: WhitenParams = WhitenParams()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each
    usable vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(embeddings)
    dims = common_length(rows)
    if dims is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == dims)
    fit = fitted(rows, dims, p)
    error = identity_error(rows, fit, p)
    count, k = len(fit.values), fit.varied
    explained = [float(v) / fit.trace if fit.trace > 0 else None for v in fit.values]

    def tell(batches):
        for part in _blocks(batches):
            x = whole(_matrix(part.column("vector"), dims), p)
            m = len(x)
            w = np.full((m, count), np.nan)
            w[:, :k] = projected(x, fit)
            blank = np.tile(np.arange(count) >= k, m)
            yield {
                "vec_id": part.column("vec_id").take(pa.array(np.repeat(np.arange(m), count))),
                "component": np.tile(np.arange(1, count + 1, dtype=np.int32), m),
                "n": np.full(m * count, fit.n),
                "deviation": [v for v in squares(deviations(x, fit)) for _ in range(count)],
                "whitened": pa.array(w.ravel(), mask=blank),
                "explained": explained * m,
                "identity_error": pa.array([error] * (m * count), pa.float64()),
            }

    return C.arrow_map(rows, tell, schema)


def squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exact; null beyond a long."""
    if d.dtype != object and len(d) and float(np.abs(d).max()) ** 2 * d.shape[1] < 2**62:
        return (d * d).sum(1).tolist()
    sums = (sum(int(v) * int(v) for v in row) for row in d)
    return [s if s < 2**63 else None for s in sums]
