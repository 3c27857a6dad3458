"""Quality rules: two base rules, then robust multivariate outliers.

Statistics of every whole text are counted once. A document fails the base rules if
it has too few words or too many of its words stand in repeated 5-word windows. The
others of one language and source are compared with each other: a minimum covariance
determinant estimate (Rousseeuw, 1984; concentration steps of Rousseeuw and Van
Driessen, 1999) gives the centre and spread of their transformed statistics without
letting junk widen them, and a document far out in Mahalanobis distance is rejected.

The estimate is worked out by grouped aggregation for all groups at once, from the four
fixed starts of ``STARTS`` (as in deterministic searches: Hubert, Rousseeuw and Verdonck,
2012). Each concentration step takes the share ``support`` of a group with the smallest
distances (a quantile of the distances) and sums their moments. After ``trial_steps``
steps the start of least determinant goes on, group by group, until a step lowers its
determinant no more; the least one seen is the estimate. ``steps`` bounds the rest. So a
source that holds a third of all rows is a few partial sums per task, and no group is
ever gathered. Determinants are those of the covariances with ``floors`` (below).

Spreads are the group's own. Only where one is under a small minimum (``floors``) it is
raised to that: a statistic that is zero for nearly all documents must not condemn the
first that has one symbol. A share of few words, lines or characters is a weak witness,
so each statistic is first drawn toward its group's median, as if ``sizes`` more units
stood there. Groups under ``least_group`` rows are pooled by language, and languages
still under it together; a pool under it rejects nobody.

Null texts have no words and fail the base rules. Null languages and sources are
groups of their own. Repeated rows count each. Rows that share ``doc_id``, text,
language and source share the verdict. An empty table gives an empty result. Other
columns are carried along by ``keep_good`` and ignored otherwise.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C

WHITE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
#: Punctuation that prose carries in small, steady shares.
MARKS = b"!?.,;:\"'()[]{}/\\=_~^+-@"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
WINDOW = 5
#: Where concentration starts, by what is made of robust z-scores before they are correlated:
#: nothing in common, hyperbolic tangents, spatial signs, Cauchy weights.
STARTS = ("apart", "tanh", "signs", "weights")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_marks", "n_upper"]


@dataclass(frozen=True)
class QualityParams:
    least_words: int = 10
    most_repeat_percent: int = 20
    support: float = 0.75  # share of a group that the estimate rests on
    trial_steps: int = 2  # from every start
    steps: int = 15  # more, at most, from the best of them
    least_fall: float = 1e-6  # of the logarithm of a determinant
    least_group: int = 100
    #: Normal quantile of the chi-square cutoff: one clean document in 10,000.
    cutoff: float = 3.72
    #: Least standard deviation of each transformed statistic, in the order of ``vector``.
    floors: tuple = (0.3, 0.2, 0.03, 0.10, 0.08, 0.02, 0.02)
    #: Units (of ``units``) at the group's median that each statistic is mixed with.
    sizes: tuple = (0, 200, 100, 10, 100, 800, 800)


def text_counts(text: bytes) -> tuple[int, ...]:
    """COUNTS, then MORE."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return (
        n,
        len(text.translate(None, WHITE + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, MARKS)),
        len(text) - len(text.translate(None, UPPER)),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    windows = [joined[a : b - 1] for a, b in zip(starts, starts[WINDOW:])]
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = upto = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + WINDOW - max(i, upto)
            upto = i + WINDOW
    return covered


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source (as text), a hash of text, lang and source, and the counts."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.to_json(F.struct(lang.alias("lang"))).alias("lang"),
        F.to_json(F.struct(lang.alias("lang"), source.alias("source"))).alias("site"),
        row_hash(docs).alias("row_hash"),
        F.col("text").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for part in C.slices(batches, "text"):
            found = [text_counts(t or b"") for t in C.blobs(part.column("text"))]
            columns = dict(zip(COUNTS + MORE, zip(*found)))
            yield {c: part.column(c) for c in ("doc_id", "lang", "site", "row_hash")} | columns

    counts = ", ".join(f"{c} long" for c in COUNTS + MORE)
    return C.arrow_map(rows, run, f"doc_id long, lang string, site string, row_hash long, {counts}")


def row_hash(docs: DataFrame) -> Column:
    named = [F.col(c).cast("string") for c in ("text", "lang", "source") if c in docs.columns]
    return F.xxhash64(*[F.coalesce(c, F.lit("\u0000")) for c in named])


def vector() -> list[Column]:
    """Transformed statistics: size, word length, then square roots of shares."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt(F.col("n_marks") / chars),
        F.sqrt(F.col("n_upper") / chars),
    ]


def units() -> list[Column]:
    """What each statistic of ``vector`` is a share or mean of."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return [words, words, chars, lines, words, chars, chars]


def base_failed(p: QualityParams) -> Column:
    return (F.col("n_words") < p.least_words) | (100 * F.col("n_repeat_words") > p.most_repeat_percent * F.col("n_words"))


def chi_square(dims: int, z: float) -> float:
    """Quantile of a chi-square at a normal quantile (Wilson and Hilferty, 1931)."""
    return dims * (1 - 2 / (9 * dims) + z * math.sqrt(2 / (9 * dims))) ** 3


def _grouped(rows: DataFrame, p: QualityParams) -> DataFrame:
    """``rows`` with ``grp``: site, else language, else all; null where even that is too few."""
    sites = rows.groupBy("lang", "site").agg(F.count(F.lit(1)).alias("n"))
    small = sites.filter(F.col("n") < p.least_group)
    langs = small.groupBy("lang").agg(F.sum("n").alias("pool"))
    rest = langs.filter(F.col("pool") < p.least_group).agg(F.sum("pool")).first()[0] or 0
    named = sites.join(langs, "lang", "left").select(
        "site",
        F.when(F.col("n") >= p.least_group, F.concat(F.lit("site "), "site"))
        .when(F.col("pool") >= p.least_group, F.concat(F.lit("lang "), "lang"))
        .when(F.lit(rest >= p.least_group), F.lit("rest"))
        .alias("grp"),
    )
    return rows.join(named, "site")


def _estimates(moments: DataFrame, p: QualityParams) -> DataFrame:
    """grp, start, centre, precision (row by row) and log determinant of the covariance from
    the means and products of each group and start."""
    dims = len(p.floors)
    floors = np.square(np.array(p.floors))

    def invert(batches):
        for batch in batches:
            shift = np.array(batch.column("centre").to_pylist(), float).reshape(-1, dims)
            mean = np.array(batch.column("mean").to_pylist(), float).reshape(-1, dims)
            cross = np.array(batch.column("cross").to_pylist(), float).reshape(-1, dims, dims)
            cov = cross - mean[:, :, None] * mean[:, None, :]
            own = np.diagonal(cov, axis1=1, axis2=2)
            # a thousandth more, so that statistics that go together can be inverted
            cov = cov + np.eye(dims) * (np.maximum(0, floors - own) + floors / 1000)[:, None, :]
            yield {
                "grp": batch.column("grp"),
                "start": batch.column("start"),
                "centre": (shift + mean).tolist(),
                "precision": np.linalg.inv(cov).reshape(-1, dims * dims).tolist(),
                "log_det": np.linalg.slogdet(cov)[1].tolist(),
            }

    return C.arrow_map(moments, invert, "grp string, start int, centre array<double>, precision array<double>, log_det double")


def _distance(dims: int) -> Column:
    off = [F.col(f"x{i}") - F.col("centre")[i] for i in range(dims)]
    terms = [off[i] * off[j] * F.col("precision")[i * dims + j] * (1 if i == j else 2) for i in range(dims) for j in range(i, dims)]
    return sum(terms[1:], terms[0])


def _starts(rows: DataFrame, p: QualityParams) -> DataFrame:
    """grp, start, centre, mean (zeros) and cross (covariance, row by row) of each of STARTS."""
    dims = len(p.floors)
    xs = [f"x{i}" for i in range(dims)]
    quartiles = rows.groupBy("grp").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 2_000).alias(f"q_{x}") for x in xs])
    middles = C.settle(
        quartiles.select(
            "grp",
            F.array(*[F.col(f"q_{x}")[1] for x in xs]).alias("centre"),
            F.array(*[F.greatest((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349, F.lit(f)) for x, f in zip(xs, p.floors)]).alias("spread"),
        ),
        "middles",
    )
    scored = rows.join(middles, "grp").select("grp", *[((F.col(x) - F.col("centre")[i]) / F.col("spread")[i]).alias(f"z{i}") for i, x in enumerate(xs)])
    z = [F.col(f"z{i}") for i in range(dims)]
    scored = scored.withColumn("norm2", sum((x * x for x in z[1:]), z[0] * z[0]))
    made = {
        "tanh": [F.tanh(x) for x in z],
        "signs": [F.when(F.col("norm2") > 0, x / F.sqrt("norm2")).otherwise(0.0) for x in z],
        "weights": [x / (1 + F.col("norm2") / dims) for x in z],
    }
    each = F.explode(F.array(*[F.struct(F.lit(STARTS.index(k)).alias("start"), *[u.alias(f"u{i}") for i, u in enumerate(us)]) for k, us in made.items()]))
    flat = scored.select("grp", each.alias("s")).select("grp", "s.*")
    sums = flat.groupBy("grp", "start").agg(*[F.avg(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"c{i}_{j}") for i in range(dims) for j in range(i, dims)])

    def covariance(i: int, j: int) -> Column:
        both = F.col("spread")[i] * F.col("spread")[j]
        if i == j:
            return both
        own = F.col(f"c{i}_{i}") * F.col(f"c{j}_{j}")
        return F.when(own > 0, both * F.col(f"c{min(i, j)}_{max(i, j)}") / F.sqrt(own)).otherwise(0.0)

    def described(start: Column, cross: Column) -> list[Column]:
        return [F.col("grp"), start.alias("start"), F.col("centre"), F.array(*[F.lit(0.0)] * dims).alias("mean"), cross.alias("cross")]

    together = F.array(*[covariance(i, j) for i in range(dims) for j in range(dims)])
    apart = F.array(*[F.pow(F.col("spread")[i], 2) if i == j else F.lit(0.0) for i in range(dims) for j in range(dims)])
    return middles.select(*described(F.lit(STARTS.index("apart")), apart)).union(sums.join(middles, "grp").select(*described(F.col("start"), together)))


def _concentrated(rows: DataFrame, now: DataFrame, p: QualityParams) -> DataFrame:
    """One concentration step from each estimate of ``now``; settled."""
    dims = len(p.floors)
    far = rows.join(now, "grp").withColumn("d2", _distance(dims))
    # written first, as the estimates are: joins of plain tables can be split at a hot group
    cut = C.settle(far.groupBy("grp", "start").agg(F.percentile_approx("d2", p.support, 2_000).alias("cut")), "robust_cut")
    off = [F.col(f"x{i}") - F.col("centre")[i] for i in range(dims)]
    near = far.join(cut, ["grp", "start"]).filter("d2 <= cut").select("grp", "start", "centre", *[off[i].alias(f"o{i}") for i in range(dims)])
    sums = near.groupBy("grp", "start").agg(
        F.first("centre").alias("centre"),
        *[F.avg(f"o{i}").alias(f"m{i}") for i in range(dims)],
        *[F.avg(F.col(f"o{i}") * F.col(f"o{j}")).alias(f"c{i}_{j}") for i in range(dims) for j in range(i, dims)],
    )
    moments = sums.select(
        "grp", "start", "centre", F.array(*[f"m{i}" for i in range(dims)]).alias("mean"),
        F.array(*[f"c{min(i, j)}_{max(i, j)}" for i in range(dims) for j in range(dims)]).alias("cross"),
    )
    nearer = C.settle(_estimates(moments, p), "robust")
    C.discard(cut)
    return nearer


def robust_estimates(rows: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """grp, centre, precision, log_det, scale (of squared distances) from ``rows`` (grp, x0, x1, ...)."""
    dims = len(p.floors)
    now = C.settle(_estimates(_starts(rows, p), p), "robust")
    for _ in range(p.trial_steps):
        now, before = _concentrated(rows, now, p), now
        C.discard(before)
    fields = ["start", "centre", "precision", "log_det"]
    # equal determinants: the first start
    least = now.groupBy("grp").agg(F.min_by(F.struct(*fields), F.struct("log_det", "start")).alias("e")).select("grp", "e.*")
    best = C.settle(least.withColumn("falling", F.lit(True)), "robust")
    C.discard(now)
    for _ in range(p.steps):
        if best.filter("falling").isEmpty():
            break
        nearer = _concentrated(rows, best.filter("falling"), p)
        after = nearer.select("grp", F.struct(*fields).alias("e"))
        fell = F.coalesce(F.col("e.log_det") < F.col("log_det") - p.least_fall, F.lit(False))
        chosen = [F.when(fell, F.col(f"e.{c}")).otherwise(F.col(c)).alias(c) for c in fields]
        best, before = C.settle(best.join(after, "grp", "left").select("grp", *chosen, fell.alias("falling")), "robust"), best
        C.discard(nearer, before)
    middle = rows.join(best, "grp").groupBy("grp").agg(F.percentile_approx(_distance(dims), 0.5, 2_000).alias("middle"))
    scale = F.greatest(F.lit(1.0), F.col("middle") / chi_square(dims, 0.0))
    return C.settle(best.join(middle, "grp").select("grp", "centre", "precision", "log_det", scale.alias("scale")), "robust")


def _toward_middle(rows: DataFrame, p: QualityParams) -> DataFrame:
    """``rows`` with each statistic drawn toward its group's median by what ``sizes`` says."""
    xs = [f"x{i}" for i in range(len(p.floors))]
    medians = rows.filter("grp is not null").groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 2_000).alias(f"m{x}") for x in xs])
    found = rows.join(C.settle(medians, "medians"), "grp", "left")
    drawn = {x: F.col(f"m{x}") + (F.col(x) - F.col(f"m{x}")) * F.sqrt(n / (n + F.lit(more))) for x, n, more in zip(xs, units(), p.sizes)}
    return found.withColumns(drawn).drop(*[f"m{x}" for x in xs])


def verdicts(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """Columns of ``statistics`` with base_failed, distance (squared; null where no
    estimate applies) and kept."""
    dims = len(p.floors)
    counted = C.settle(statistics(docs), "text_statistics")
    judged = counted.withColumn("base_failed", base_failed(p)).withColumns({f"x{i}": x for i, x in enumerate(vector())})
    grouped = C.settle(_grouped(judged.filter("not base_failed"), p), "grouped_statistics")
    rows = C.settle(_toward_middle(grouped, p), "drawn_statistics")
    C.discard(grouped)
    found = rows.join(robust_estimates(rows.filter("grp is not null"), p).drop("log_det"), "grp", "left")
    passed = found.withColumn("distance", _distance(dims) / F.col("scale"))
    limit = chi_square(dims, p.cutoff)
    keep = ["doc_id", "row_hash", "lang", "site", *COUNTS, *MORE, "base_failed"]
    return passed.select(*keep, "distance", F.coalesce(F.col("distance") <= limit, F.lit(True)).alias("kept")).union(
        judged.filter("base_failed").select(*keep, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    )


def digest(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    return verdicts(docs, p).select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """``docs`` without rejected rows."""
    bad = verdicts(docs, p).filter("not kept").select("doc_id", "row_hash")
    return C.without(docs, {"doc_id": F.col("doc_id").cast("long"), "row_hash": row_hash(docs)}, bad)
