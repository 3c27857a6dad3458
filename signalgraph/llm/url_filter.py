"""Allows or blocks urls: by rules, else by the words of their host and path.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
path: from there up to ``?``, ``#`` or the end; both are empty without ``://``.

1. *Rules* such as ``org/`` or ``example.org/es/`` fit their host and all its subdomains
   where the path starts with the rule's; the longest wins (ties: block, then the text).
   Each distinct host meets the rules of its suffixes in an equi-join; pages then meet
   their host's.
2. *Words.* Host and path are cut into runs of letters and of digits. Runs of letters are
   names that may be several words in one: each distinct name is offered all its pieces of
   up to ``longest_word`` letters, these meet the counts of the corpus's words in an
   equi-join, and a Viterbi search over the name takes the split with the greatest product
   of word probabilities. A piece that is no word of the corpus has 10 / (total * 10^length).
   Ties go to fewer words, then to the longer last word.
3. *Scores.* Pages that a rule decides teach a multinomial naive Bayes model of words, host
   and path apart (a number counts by its first digit). ``seeds`` are words known from
   unwanted hosts; each is taught as ``seed_share`` of the blocked words. Counts are smoothed
   by one; words of no taught page say nothing. Pages without a rule are blocked where
   the log odds are above 0.

Everything is counted over all pages and all texts, by grouped sums with combining on the map
side. Names, words and scores are worked out once per distinct host and path shape (digits by
their first), so a host that holds a third of the pages is one row until the last join, which
adaptive execution splits. Log odds are added as whole numbers of 2^-32: sums do not depend
on their order.

Letters in a row beyond ``longest_name`` (a host label has 63 at most) are cut there. Null
urls have empty host and path and are judged by the prior alone. Rows come back each, repeated
ones and null ids too. Without a page that a rule decides, seeds and priors judge. Columns
other than ``page_id`` and ``url`` (``text`` of the corpus) are ignored. Empty tables give
no rows; an empty corpus leaves names whole.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgraph.llm import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT = 2**32


@dataclass(frozen=True)
class UrlParams:
    #: verdict and rule: host, then the beginning of the path from its first ``/`` on
    rules: tuple[tuple[str, str], ...] = (
        ("allow", "org/"),
        ("block", "example.org/es/"),
        ("block", "example.org/en/1"),
        ("allow", "com/fr/"),
        ("block", "com/de/"),
    )
    seeds: tuple[str, ...] = ("adult", "ads", "bet", "bets", "casino", "pills", "poker", "porn", "spam")
    seed_share: float = 0.03
    longest_word: int = 20
    longest_name: int = 63


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


# --- rules ------------------------------------------------------------------------------


def rule_rows(p: UrlParams) -> list[tuple[str, str, str, str]]:
    """suffix (host of the rule), start of the path, rule, verdict."""
    rows = []
    for verdict, rule in p.rules:
        host, slash, path = rule.partition("/")
        rows.append((host.translate(str.maketrans(UPPER, LOWER)), slash + path, rule, verdict))
    return rows


def rules_of_hosts(hosts: DataFrame, p: UrlParams) -> DataFrame:
    """host, rules: those whose host it is or is below, longest first."""
    spark = hosts.sparkSession
    rules = spark.createDataFrame(rule_rows(p), "suffix string, begins string, rule string, verdict string")
    labels = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    fit = hosts.select("host", F.explode(suffixes).alias("suffix")).distinct().join(rules, "suffix")
    rank = F.struct((-F.length("rule")).alias("size"), (F.col("verdict") == "allow").alias("mild"), "rule", "begins", "verdict")
    return fit.groupBy("host").agg(F.sort_array(F.collect_set(rank)).alias("rules"))


def ruled(pages: DataFrame, p: UrlParams) -> DataFrame:
    """page_id, host, path, shape, rule, ruled (its verdict)."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("shape", F.array_join(_runs(F.col("path")), " "))
    hosts = C.settle(rules_of_hosts(rows.select("host").distinct(), p), "host_rules")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["begins"])), 0)
    return (
        rows.join(hosts, "host", "left")
        .withColumn("first", first)
        .select("page_id", "host", "path", "shape", F.col("first.rule").alias("rule"), F.col("first.verdict").alias("ruled"))
    )


# --- words -------------------------------------------------------------------------------


def _runs(text: Column) -> Column:
    """Runs of letters in lower case (A-Z), and numbers as # and their first digit."""
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("\\p{L}+|[0-9]+"), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("#"), F.substring(t, 1, 1))).otherwise(t))


def _names(run: Column, p: UrlParams) -> Column:
    """A run of letters in parts of no more than ``longest_name``."""
    starts = F.sequence(F.lit(1), F.length(run), F.lit(p.longest_name))
    return F.transform(starts, lambda k: F.substring(run, k, F.lit(p.longest_name)))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: runs of letters of ``text``, A-Z in lower case."""
    import regex

    letters = regex.compile(r"\p{L}+")
    fold = str.maketrans(UPPER, LOWER)

    def count(batches):
        for part in C.slices(batches, "text"):
            seen = Counter()
            for text in part.column("text").to_pylist():
                seen.update(letters.findall((text or "").translate(fold)))
            yield {"word": list(seen), "n": list(seen.values())}

    found = C.arrow_map(texts.select(F.col("text").cast("string").alias("text")), count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def best_split(name: str, counts: dict[str, int], total: int, longest: int) -> list[str]:
    """The most probable words that ``name`` is made of; ``counts`` holds its pieces' counts."""
    if total <= 0:
        return [name]
    ten = math.log(10.0)
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # log probability, -words, length of the last word
    for end in range(1, len(name) + 1):
        found = []
        for size in range(1, min(longest, end) + 1):
            n = counts.get(name[end - size : end], 0)
            word = math.log(n / total) if n else ten - math.log(total) - size * ten
            before = best[end - size]
            found.append((before[0] + word, before[1] - 1, size))
        best.append(max(found))
    words, end = [], len(name)
    while end:
        size = best[end][2]
        words.append(name[end - size : end])
        end -= size
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame, p: UrlParams) -> DataFrame:
    """name, words of each distinct name; ``counts`` are (word, n)."""
    spark = names.sparkSession
    seeds = spark.createDataFrame([(w,) for w in p.seeds], "word string")
    counts = C.settle(counts, "word_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # a seed that the corpus lacks is a word all the same, as rare as one seen once
    counts = counts.join(seeds, "word", "full").select("word", F.coalesce("n", F.lit(1)).alias("n"))
    long = F.length("name")
    spans = names.select("name", F.explode(F.sequence(F.lit(1), long)).alias("at")).withColumn(
        "size", F.explode(F.sequence(F.lit(1), F.least(F.lit(p.longest_word), F.length("name") - F.col("at") + 1)))
    )
    pieces = spans.select("name", F.substring(F.col("name"), F.col("at"), F.col("size")).alias("word")).distinct()
    known = pieces.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.arrow_udf("array<string>")
    def split(name: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for word, pairs in zip(name.to_pylist(), known.to_pylist()):
            held = {x["word"]: x["n"] for x in pairs or []}
            out.append(best_split(word, held, total, p.longest_word))
        return pa.array(out, pa.list_(pa.string()))

    return names.join(known, "name", "left").select("name", split("name", "known").alias("words"))


# --- scores ------------------------------------------------------------------------------


def tokens_of(keys: DataFrame, corpus: DataFrame, p: UrlParams) -> DataFrame:
    """host, shape, token, times for distinct (host, shape)."""
    host = F.transform(_runs(F.col("host")), lambda t: F.struct(F.lit("h").alias("side"), t.alias("run")))
    path = F.transform(F.filter(F.split("shape", " "), lambda t: t != ""), lambda t: F.struct(F.lit("p").alias("side"), t.alias("run")))
    runs = C.settle(keys.select("host", "shape", F.inline(F.concat(host, path))), "url_runs")
    numbers = runs.filter(F.startswith("run", F.lit("#"))).select("host", "shape", "side", F.col("run").alias("word"))
    letters = runs.filter(~F.startswith("run", F.lit("#"))).select(
        "host", "shape", "side", F.explode(_names(F.col("run"), p)).alias("name")
    )
    words = C.settle(segmented(letters.select("name").distinct(), word_counts(corpus), p), "name_words")
    spelt = letters.join(words, "name").select("host", "shape", "side", F.explode("words").alias("word"))
    return (
        spelt.union(numbers)
        .groupBy("host", "shape", F.concat_ws(":", "side", "word").alias("token"))
        .agg(F.count(F.lit(1)).alias("times"))
    )


def weights(tokens: DataFrame, taught: DataFrame, p: UrlParams) -> tuple[DataFrame, int]:
    """token, weight (log odds for block in units), and the prior's; ``taught`` are
    (host, shape, ruled, pages)."""
    spark = tokens.sparkSession
    blocked = F.col("ruled") == "block"
    pages = taught.agg(*[F.sum(F.when(c, F.col("pages"))) for c in (blocked, ~blocked)]).first()
    n_block, n_allow = pages[0] or 0, pages[1] or 0
    seen = F.col("times") * F.col("pages")
    counts = C.settle(
        tokens.join(taught, ["host", "shape"])
        .groupBy("token")
        .agg(F.sum(F.when(blocked, seen).otherwise(0)).alias("block"), F.sum(F.when(blocked, 0).otherwise(seen)).alias("allow")),
        "token_counts",
    )
    held = counts.agg(F.sum("block"), F.sum("allow")).first()
    each = max(1, round(p.seed_share * (held[0] or 0)))
    seeds = spark.createDataFrame([(f"h:{w}", each) for w in sorted(set(p.seeds))], "token string, extra long")
    counts = counts.join(seeds, "token", "full").select(
        "token", (F.coalesce("block", F.lit(0)) + F.coalesce("extra", F.lit(0))).alias("block"), F.coalesce("allow", F.lit(0)).alias("allow")
    )
    kinds = counts.count()
    all_block, all_allow = (held[0] or 0) + each * len(set(p.seeds)) + kinds, (held[1] or 0) + kinds
    odds = F.log((F.col("block") + 1) / F.lit(float(all_block))) - F.log((F.col("allow") + 1) / F.lit(float(all_allow)))
    prior = round(UNIT * (math.log(n_block + 1) - math.log(n_allow + 1)))
    return counts.select("token", F.round(odds * UNIT).cast("long").alias("weight")), prior


def scored(judged: DataFrame, corpus: DataFrame, p: UrlParams) -> tuple[DataFrame, int]:
    """host, shape, odds (whole units, without the prior's) of each distinct (host, shape),
    and the prior. ``judged`` are (host, shape, ruled)."""
    keys = C.settle(judged.groupBy("host", "shape", "ruled").agg(F.count(F.lit(1)).alias("pages")), "url_shapes")
    tokens = C.settle(tokens_of(keys.select("host", "shape").distinct(), corpus, p), "url_tokens")
    weight, prior = weights(tokens, keys.filter("ruled is not null"), p)
    odds = tokens.join(weight, "token").groupBy("host", "shape").agg(F.sum(F.col("times") * F.col("weight")).alias("odds"))
    return C.settle(odds, "url_odds"), prior


def judged(pages: DataFrame, corpus: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, odds (log odds for block by the words)."""
    rows = C.settle(ruled(pages, p), "ruled_pages")
    odds, prior = scored(rows, corpus, p)
    total = F.coalesce("odds", F.lit(0)) + F.lit(prior)
    own = F.when(total > 0, "block").otherwise("allow")
    return rows.join(odds, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), (total / UNIT).alias("odds")
    )


def keep_allowed(pages: DataFrame, corpus: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """``pages`` without the rows whose url is blocked."""
    urls = pages.select(F.xxhash64("url").alias("page_id"), "url")
    blocked = judged(urls, corpus, p).filter("verdict = 'block'").select("host", "path")
    host, path = host_and_path(F.col("url").cast("string"))
    return C.without(pages, {"host": host, "path": path}, blocked)
