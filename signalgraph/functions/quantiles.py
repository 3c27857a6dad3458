"""Exact interpolated quantiles of (sliding) windows, safe for hot groups.

The built-in ``percentile`` keeps every distinct value of a group in one
task. Here a group is never held whole: values are counted in coarse,
order-preserving bins first, the bins holding the wanted ranks are found from
those counts, and only rows of these bins are sorted. Rows are not multiplied
by the number of windows they belong to either; only the few chosen ones are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgraph.functions.ordered import spread_by

BINS_PER_E = 16  # bins per factor e of the value; more bins mean smaller sorts and larger histograms

SLICE_WINDOWS = 64  # window lengths per slice of running totals


def value_bin(value) -> Column:
    """Never decreases with ``value``; at most ~23,000 bins over all doubles."""
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(F.signum(v) * F.floor(F.log1p(F.abs(v) * 1000.0) * BINS_PER_E)).cast("int")


def window_rollup(
    rows: DataFrame,
    keys: list[str],
    value: str,
    sums: dict[str, Column],
    probs: dict[str, float],
    span: int = 1,
    last: int | None = None,
) -> DataFrame:
    """Counts, sums, mean and exact quantiles of ``value`` per window and key.

    ``rows`` has a whole-number column ``pane``; window ``tick`` covers the panes
    ``tick - span .. tick - 1``. Windows after ``last`` are left out. Gives
    ``keys, tick, total, <sums>, mean, <probs>``.
    """
    counted = ["total", *sums, "value_sum"]
    panes = rows.groupBy(*keys, "pane").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.sum(c).alias(s) for s, c in sums.items()],
        F.sum(value).alias("value_sum"),
    )
    if probs:
        return quantile_rollup(count_cells(rows, keys, value, sums), keys, list(sums), probs, span, last, panes)
    wins = window_sums(panes, keys, counted, span, last)
    return wins.select(*keys, "tick", "total", *sums, (F.col("value_sum") / F.col("total")).alias("mean"))


def window_sums(panes: DataFrame, keys: list[str], counted: list[str], span: int, last: int | None) -> DataFrame:
    """Sums of the panes of each window. Panes are sent to their chunks of windows and
    spread over the windows there, so what is shuffled isn't multiplied by them."""
    if span == 1:
        wins = panes.withColumn("tick", F.col("pane") + 1)
        return (wins if last is None else wins.filter(F.col("tick") <= last)).select(*keys, "tick", *counted)
    lasting = panes.withColumns({"from_tick": F.col("pane") + 1, "until_tick": _at_most(F.col("pane") + span, last)})
    spread = by_tick(lasting.select(*keys, "from_tick", "until_tick", *counted), keys, span)
    return spread.groupBy(*keys, "chunk", "tick").agg(*[F.sum(c).alias(c) for c in counted]).drop("chunk")


def by_tick(lasting: DataFrame, keys: list[str], span: int) -> DataFrame:
    """A row for each ``tick`` of ``from_tick .. until_tick``, partitioned by key and ``chunk``
    of ``span`` ticks; rows are multiplied only after they are shuffled."""
    start, end = F.col("chunk") * span, F.col("chunk") * span + span - 1
    chunks = F.sequence(F.floor(F.col("from_tick") / F.lit(span)), F.floor(F.col("until_tick") / F.lit(span)))
    cut = lasting.filter(F.col("until_tick") >= F.col("from_tick")).withColumn("chunk", F.explode(chunks))
    return (
        spread_by(cut, *keys, "chunk")
        .withColumn("tick", F.explode(F.sequence(F.greatest("from_tick", start), F.least("until_tick", end))))
        .drop("from_tick", "until_tick")
    )


def _at_most(tick: Column, last: int | None) -> Column:
    return tick if last is None else F.least(tick, F.lit(last).cast("bigint"))


def count_cells(rows: DataFrame, keys: list[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """Rows counted per pane, bin and exact value ``v``; adds up map-side."""
    return rows.groupBy(*keys, "pane", value_bin(value).alias("bin"), F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("total"), *[F.sum(c).alias(s) for s, c in sums.items()]
    )


def quantile_rollup(
    cells: DataFrame,
    keys: list[str],
    sums: list[str],
    probs: dict[str, float],
    span: int = 1,
    last: int | None = None,
    panes: DataFrame | None = None,
) -> DataFrame:
    """``window_rollup`` from ``count_cells`` output, which may be a stored table;
    ``panes`` are its sums per pane, if they are there already."""
    if panes is None and sums:
        panes = cells.groupBy(*keys, "pane").agg(*[F.sum(c).alias(c) for c in sums])
    hist = sliding_histogram(cells, keys, span, last)

    def block_of(pane: Column) -> Column:
        """Runs of ``span`` panes: a window touches two at most."""
        return F.floor(pane / F.lit(span))

    by_bin = Window.partitionBy("tick", "chunk", *keys).orderBy("bin")
    climbing = by_bin.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = by_bin.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = F.array_distinct(
        F.flatten(F.array(*[F.array(F.floor(_place(p)), F.ceil(_place(p))) for p in probs.values()]))
    )
    chosen = (
        hist.withColumn("upto", F.sum("total").over(climbing))
        .withColumns({"w_total": F.sum("total").over(whole), "w_value_sum": F.sum("value_sum").over(whole)})
        .withColumn("start", F.col("upto") - F.col("total"))
        .filter(F.exists(places, lambda r: (r >= F.col("start")) & (r < F.col("upto"))))
        .select(*keys, "tick", "bin", "start", "w_total", "w_value_sum")
        .withColumn("block", F.explode(F.array_distinct(F.array(block_of(F.col("tick") - span), block_of(F.col("tick") - 1)))))
    )
    within = Window.partitionBy(*keys, "tick", "bin").orderBy("v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    in_window = (F.col("pane") >= F.col("tick") - span) & (F.col("pane") < F.col("tick"))
    ranked = (
        chosen.join(
            cells.select(*keys, "pane", "bin", "v", "total", block_of(F.col("pane")).alias("block")),
            [*keys, "bin", "block"],
        )
        .filter(in_window)
        .withColumn("upto", F.col("start") + F.sum("total").over(within))
        .withColumn("start", F.col("upto") - F.col("total"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("start")) & (rank < F.col("upto")), F.col("v")))

    picked = [
        col
        for name, p in probs.items()
        for col in (at(F.floor(_place(p))).alias(f"{name}_lo"), at(F.ceil(_place(p))).alias(f"{name}_hi"))
    ]
    found = ranked.groupBy(*keys, "tick", "w_total").agg(F.max("w_value_sum").alias("w_value_sum"), *picked)
    if sums:
        found = found.join(window_sums(panes, keys, sums, span, last), [*keys, "tick"])
    return found.select(
        *keys,
        "tick",
        F.col("w_total").alias("total"),
        *sums,
        (F.col("w_value_sum") / F.col("w_total")).alias("mean"),
        *[
            (
                F.col(f"{name}_lo")
                + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (_place(p) - F.floor(_place(p)))
            ).alias(name)
            for name, p in probs.items()
        ],
    )


def sliding_histogram(cells: DataFrame, keys: list[str], span: int, last: int | None) -> DataFrame:
    """Counts and sums of values per key, bin and window, partitioned by key and chunk of windows.

    A pane enters the windows at one tick and leaves them at another, so running
    totals over these changes are the window's sums; each lasts until the next
    change. Nothing is multiplied by the number of windows a row is in. Time is cut
    into slices with totals of their own, so a key that is always busy is shared
    among tasks and rounding errors do not build up.
    """
    counted = ["total", "value_sum"]
    cells = cells.withColumn("value_sum", F.col("v") * F.col("total"))
    if span == 1:
        hist = cells.groupBy(*keys, "pane", "bin").agg(*[F.sum(c).alias(c) for c in counted])
        hist = hist.withColumns({"tick": F.col("pane") + 1, "chunk": F.col("pane") + 1}).drop("pane")
        return hist if last is None else hist.filter(F.col("tick") <= last)
    length = span * SLICE_WINDOWS

    def slice_of(tick: Column) -> Column:
        return F.floor(tick / F.lit(length))

    slice_end = (F.col("slice") + 1) * length
    enter = F.struct(F.greatest(F.col("pane") + 1, F.col("slice") * length).alias("tick"), *counted)
    leave = F.struct((F.col("pane") + span + 1).alias("tick"), *[(-F.col(c)).alias(c) for c in counted])
    changes = (
        cells.withColumn(
            "slice",
            F.explode(F.array_distinct(F.array(slice_of(F.col("pane") + 1), slice_of(F.col("pane") + span)))),
        )
        .select(*keys, "bin", "slice", F.explode(F.array(enter, leave)).alias("c"))
        .select(*keys, "bin", "slice", "c.*")
        .filter(F.col("tick") < slice_end)
        .groupBy(*keys, "bin", "slice", "tick")
        .agg(*[F.sum(c).alias(c) for c in counted])
    )
    in_time = Window.partitionBy(*keys, "bin", "slice").orderBy("tick")
    so_far = in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = changes.select(
        *keys,
        "bin",
        F.col("tick").alias("from_tick"),
        _at_most(F.coalesce(F.lead("tick").over(in_time), slice_end) - 1, last).alias("until_tick"),
        *[F.sum(c).over(so_far).alias(c) for c in counted],
    )
    return by_tick(running.filter(F.col("total") > 0), keys, span)


def _place(p: float) -> Column:
    """Position of quantile ``p`` among ``w_total`` sorted values, from 0."""
    return (F.col("w_total") - 1) * F.lit(p)
