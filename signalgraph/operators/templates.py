"""Log template mining: masked messages are routed by their first tokens and
grouped by position-wise similarity (the Drain idea: He et al., ICWS 2017).

Only distinct masked messages are mined; their number, not the number of logs,
decides the cost. Routing is a round of grouping and joining per level. The greedy
grouping inside a leaf depends on arrival order, so it is an ordered fold;
leaves are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgraph.functions import scalars as S
from signalgraph.functions.ordered import lookup, number_rows, ordered_fold
from signalgraph.params import Params
from signalgraph.sources.logs import last_ts, within
from signalgraph.sources.staging import stage


def masked_messages(logs: DataFrame) -> DataFrame:
    """Distinct masked messages: how many rows, and which row came first."""
    first = F.min(F.struct("ts", "span_id", "service")).alias("first")
    return (
        logs.select("ts", "span_id", "service", clean().alias("masked"))
        .groupBy("masked")
        .agg(F.count(F.lit(1)).alias("n"), first)
        .select(
            "masked",
            "n",
            F.col("first.ts").alias("first_ts"),
            F.col("first.span_id").alias("first_span"),
            F.col("first.service").alias("first_service"),
        )
    )


def clean() -> Column:
    """Masked message with single blanks between its words."""
    return F.concat_ws(" ", S.tokens(S.mask("message")))


def route(masked: DataFrame, p: Params) -> DataFrame:
    """Adds ``leaf``: the length and the first tokens of each message.

    A branch takes its first ``template_children`` distinct tokens, in arrival
    order; later ones share the placeholder branch.
    """
    levels = [f"b{i}" for i in range(p.template_depth)]
    words = F.split("masked", " ")
    out = masked.withColumn("width", F.size(words))
    for i, b in enumerate(levels):
        word = F.get(words, F.lit(i))
        out = out.withColumn(b, F.when(F.startswith(word, F.lit("<")), F.lit(S.PLACEHOLDER)).otherwise(word))
    # Routing looks at first tokens only, so it runs over the distinct ones.
    starts = stage(
        out.groupBy("width", *levels).agg(F.min(F.struct("first_ts", "first_span")).alias("arrived")), "starts"
    )
    routed = starts.withColumn("leaf", F.col("width").cast("string"))
    for b in levels:  # each level is read twice by the next
        by_arrival = Window.partitionBy("leaf").orderBy("branch_arrived")
        kept = (
            routed.filter(F.col(b).isNotNull())
            .groupBy("leaf", b)
            .agg(F.min("arrived").alias("branch_arrived"))
            .withColumn("place", F.row_number().over(by_arrival))
            .filter(F.col("place") <= p.template_children)
            .select("leaf", b, F.lit(True).alias("kept"))
        )
        step = F.when(F.col("kept"), F.col(b)).when(F.col(b).isNotNull(), F.lit(S.PLACEHOLDER))
        routed = stage(routed.join(kept, ["leaf", b], "left").withColumn("leaf", F.concat_ws(" ", "leaf", step)).drop("kept"), "routes")
    same = [out["width"] == routed["width"], *[out[b].eqNullSafe(routed[b]) for b in levels]]
    return out.join(routed, same).select(*[out[c] for c in masked.columns], routed["leaf"])


class LeafGroups:
    """Token groups of one leaf. Tokens are kept as numbers, one row per group.

    A message is compared only with groups that can be alike enough. The positions are
    paired, each of the first half with one of the second (an odd last one stays alone):
    of ``pairs`` pairs, ``need`` equal positions make at least ``need - pairs`` wholly equal,
    the odd one counted as such. Groups are listed by what they hold at each pair, so all but
    the ``need - pairs - 1`` longest lists hold every group in question.
    """

    PLACEHOLDER_ID = 0
    LISTED = 256  # fewer groups are compared one by one

    def __init__(self) -> None:
        self.ids = {S.PLACEHOLDER: self.PLACEHOLDER_ID}
        self.rows: np.ndarray | None = None
        self.size = 0
        self.lists: list[dict[int, list[int]]] | None = None  # of each pair: groups by their two tokens

    def _coded(self, words: list[str]) -> list[int]:
        return [self.ids.setdefault(w, len(self.ids)) for w in words]

    def append(self, words: list[str]) -> None:
        """Takes ``words`` as one more group."""
        self._append(self._coded(words))

    def _append(self, coded: list[int]) -> None:
        if self.rows is None:
            self.rows = np.empty((4, len(coded)), dtype=np.int32)
        if self.size == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[self.size] = coded
        self.size += 1
        if self.lists is not None:
            self._list(self.size - 1, coded)
        elif self.size == self.LISTED:
            self.lists = [{} for _ in range((len(coded) + 1) // 2)]
            for group, row in enumerate(self.rows[: self.size].tolist()):
                self._list(group, row)

    def _pairs(self, coded: list[int]) -> Iterator[tuple[int, int]]:
        half = len(coded) // 2
        yield from zip(coded[:half], coded[half : 2 * half])
        if len(coded) % 2:
            yield coded[-1], self.PLACEHOLDER_ID

    def _list(self, group: int, coded: list[int], before: list[int] | None = None) -> None:
        """Lists a group by its tokens; of one that has changed, by the pairs that did."""
        old = self._pairs(before) if before else repeat(None)
        for listed, pair, was in zip(self.lists, self._pairs(coded), old):
            if pair != was:
                listed.setdefault(pair[0] << 32 | pair[1], []).append(group)

    def _asked(self, coded: list[int], threshold: float) -> np.ndarray | None:
        """Groups that may be alike enough, in order; None stands for all."""
        width = len(coded)
        sure = next((k for k in range(width + 1) if k / width >= threshold), width + 1) - width // 2
        if self.lists is None or sure < 1:
            return None
        found = []
        for listed, (a, b) in zip(self.lists, self._pairs(coded)):
            keys = {a << 32 | b, a << 32, b, 0}  # a placeholder of the group is equal to any token
            found.append([group for k in keys if k in listed for group in listed[k]])
        found.sort(key=len)
        asked = set().union(*found[: max(0, len(found) - sure + 1)])
        return np.array(sorted(asked), dtype=np.int64) if 2 * len(asked) < self.size else None

    def add(self, words: list[str], threshold: float) -> tuple[int, bool]:
        """Number of the group the message joins, from 0, and whether it is new."""
        coded = self._coded(words)
        if not self.size:
            self._append(coded)
            return 0, True
        asked = self._asked(coded, threshold)
        known = self.rows[: self.size] if asked is None else self.rows[asked]
        if len(known):
            message = np.array(coded, dtype=np.int32)
            alike = ((known == message) | (known == self.PLACEHOLDER_ID)).sum(axis=1) / len(coded)
            best = int(alike.argmax())
            if alike[best] >= threshold:
                group = best if asked is None else int(asked[best])
                self._join(group, message)
                return group, False
        self._append(coded)
        return self.size - 1, True

    def _join(self, group: int, message: np.ndarray) -> None:
        row = self.rows[group]
        other = row != message
        if row[other].any():
            before = row.tolist()
            row[other] = self.PLACEHOLDER_ID
            if self.lists is not None:
                self._list(group, row.tolist(), before)

    def texts(self) -> Iterator[str]:
        names = list(self.ids)
        for row in self.rows[: self.size]:
            yield " ".join(names[i] for i in row)


def group_leaves(routed: DataFrame, p: Params) -> DataFrame:
    """Greedy grouping in arrival order. Two kinds of rows: a message with its group, and
    a group (``masked`` null) with its final text and the count of its records."""
    threshold = p.template_similarity

    def start():
        return LeafGroups(), []

    def step(state: tuple[LeafGroups, list[int]], row: tuple):
        groups, counts = state
        leaf, first_ts, first_span, masked, n, first_service = row
        group, new = groups.add(masked.split(" "), threshold)
        if new:
            counts.append(0)
        counts[group] += n
        yield leaf, group, masked, n, first_ts, first_span, first_service, None, new

    def finish(state: tuple[LeafGroups, list[int]], key: tuple):
        groups, counts = state
        for group, (text, n) in enumerate(zip(groups.texts(), counts)):
            yield key[0], group, None, n, None, None, None, text, False

    return ordered_fold(
        routed.select("leaf", "first_ts", "first_span", "masked", "n", "first_service"),
        ["leaf"],
        ["first_ts", "first_span", "masked"],
        start,
        step,
        "leaf string, grp long, masked string, n long, first_ts double, first_span string, first_service string, text string, is_new boolean",
        finish,
    )


def mine_templates(logs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Templates, and which template each distinct masked message has.

    Ids count templates in order of arrival, from 1; a blank message has id 0
    and no template. The two frames are read from staged tables.
    """
    masked = stage(masked_messages(logs), "masked")
    folded = stage(group_leaves(route(masked.filter("masked <> ''"), p), p), "groups")
    members = folded.filter("masked IS NOT NULL")
    texts = folded.filter("masked IS NULL").select("leaf", "grp", F.col("text").alias("template"), F.col("n").alias("count"))
    # a group's first message is the one that opened it
    first = members.filter("is_new").select("leaf", "grp", "first_ts", "first_span", "first_service", "masked")
    found = texts.join(first, ["leaf", "grp"])
    span = first.agg(F.max("first_ts") - F.min("first_ts")).first()[0] or 0.0
    numbered = number_rows(found, "first_ts", ["first_span", "masked"], "template_id", max(span / 1000.0, 1.0))
    templates = stage(
        numbered.select(
            "template_id",
            "leaf",
            "grp",
            "template",
            "count",
            "first_ts",
            "first_service",
            F.col("masked").alias("first_text"),
        ),
        "templates",
    )
    assigned = members.select("masked", "n", "leaf", "grp").join(templates.select("leaf", "grp", "template_id"), ["leaf", "grp"])
    blank = masked.filter("masked = ''").select("masked", "n", F.lit(0).cast("bigint").alias("template_id"))
    return templates, assigned.select("masked", "n", "template_id").unionByName(blank)


def assign_templates(logs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Every record with its ``template_id``; common messages cannot skew the join."""
    keyed = logs.drop("template_id").withColumn("masked", clean())
    return lookup(keyed, assigned, "masked", ["template_id"]).drop("masked")


def template_list(templates: DataFrame) -> DataFrame:
    """Every template with its count, most frequent first."""
    return templates.select("template_id", "template", "count").orderBy(F.col("count").desc(), "template_id")


def template_total(templates: DataFrame) -> DataFrame:
    return templates.agg(F.count(F.lit(1)).alias("templates_tracked"))


def _template_aggregates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``level`` is the largest by its letters; ``top_level`` by severity."""
    arrival = F.struct("ts", "span_id")
    first = F.min(F.struct(arrival.alias("at"), "service", "message")).alias("first")
    named = [] if "service" in keys else [F.col("first.service").alias("service")]
    return (
        rows.filter(F.col("template_id").isNotNull())
        .groupBy(*keys)
        .agg(
            first,
            F.max("level").alias("level"),
            F.max_by("level", S.level_rank()).alias("top_level"),
            F.count(F.lit(1)).alias("count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        .select(
            *keys, *named, "level", "top_level", "count", "first_seen", "last_seen",
            F.col("first.message").alias("example"),
        )
    )


def template_explorer(
    assigned_logs: DataFrame,
    p: Params,
    limit: int = 80,
    service: str | None = None,
    level: str | None = None,
    as_of: float | None = None,
) -> DataFrame:
    """The window's most frequent templates, each with its share of the largest."""
    as_of = last_ts(assigned_logs) if as_of is None else as_of
    rows = within(assigned_logs, as_of, p.window_s)
    if service and service != "*":
        rows = rows.filter(F.col("service") == service)
    if level and level != "*":
        rows = rows.filter(F.col("level") == level)
    top = _template_aggregates(rows, ["template_id"]).orderBy(F.col("count").desc(), "template_id").limit(limit)
    largest = F.max("count").over(Window.partitionBy(F.lit(1)))
    return top.withColumn("bar_pct", F.col("count") / F.greatest(largest, F.lit(1)) * 100.0)


def top_templates_by_service(
    assigned_logs: DataFrame, p: Params, limit: int = 8, as_of: float | None = None
) -> DataFrame:
    """The most frequent templates of each service in the window."""
    as_of = last_ts(assigned_logs) if as_of is None else as_of
    found = _template_aggregates(within(assigned_logs, as_of, p.window_s), ["service", "template_id"])
    order = Window.partitionBy("service").orderBy(F.col("count").desc(), "template_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def new_templates(templates: DataFrame, p: Params, started: float) -> DataFrame:
    """Templates first seen after the warm-up, at the first tick that sees them."""
    tick_no = S.bucket_index("first_ts", p.tick_s) + 1
    return (
        templates.withColumn("tick_no", tick_no)
        .withColumn("tick", F.col("tick_no") * F.lit(p.tick_s))
        .filter(F.col("tick") - F.lit(started) >= F.lit(p.warmup_s))
        .select("tick_no", "tick", "template_id", F.col("first_service").alias("service"), "first_text")
    )
