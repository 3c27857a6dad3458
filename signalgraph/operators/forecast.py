"""Exponentially weighted mean and variance of each service's error rate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgraph.functions.ordered import ordered_fold
from signalgraph.params import Params

SLICE_TICKS = 1024


def forecast(ticks: DataFrame, p: Params, value: str = "error_rate") -> DataFrame:
    """Mean and standard deviation after every tick of every service, over its
    whole history.

    Ticks are folded in slices of time, all slices at once. What a slice makes of
    the state before it is linear in the mean and the variance, and quadratic in the
    mean for the variance, so a slice is summed up in five numbers; one row per slice
    then carries the state from slice to slice, and each slice is folded from its own.
    """
    alpha, rest = p.ewma_alpha, 1.0 - p.ewma_alpha
    sliced = ticks.select(
        "service", F.floor(F.col("tick_no") / SLICE_TICKS).alias("slice"), "tick_no", "tick", F.col(value).cast("double").alias("x")
    )

    def effect(state: list, row: tuple):
        x = row[-1]
        if not state:
            state.extend([x, 1.0, 0.0, 0.0, 0.0, 0.0])
        _, a, b, q0, q1, q2 = state
        d = x - b
        state[1:] = [
            rest * a, alpha * x + rest * b, rest * q0 + alpha * d * d, rest * q1 - 2 * alpha * d * a, rest * q2 + alpha * a * a
        ]
        return ()

    effects = ordered_fold(
        sliced.select("service", "slice", "tick_no", "x"), ["service", "slice"], ["tick_no"], list, effect,
        "service string, slice long, first double, a double, b double, q0 double, q1 double, q2 double",
        lambda state, key: [(*key, *state)],
    )

    def carry(state: list, row: tuple):
        service, part, first, a, b, q0, q1, q2 = row
        if not state:
            state.extend([first, 0.0])
        mean, variance = state
        yield service, part, mean, variance
        state[:] = [a * mean + b, a * variance + q0 + q1 * mean + q2 * mean * mean]

    starts = ordered_fold(
        effects, ["service"], ["slice"], list, carry, "service string, slice long, mean0 double, variance0 double"
    )

    def fold(state: list, row: tuple):
        service, _, tick_no, tick, x, mean0, variance0 = row
        mean, variance = state or (mean0, variance0)
        off = x - mean
        state[:] = [alpha * x + rest * mean, alpha * off * off + rest * variance]
        yield tick_no, tick, service, state[0], state[1], math.sqrt(max(state[1], 0.0))

    rows = sliced.join(starts, ["service", "slice"]).select("service", "slice", "tick_no", "tick", "x", "mean0", "variance0")
    return ordered_fold(
        rows, ["service", "slice"], ["tick_no"], list, fold,
        "tick_no long, tick double, service string, forecast double, variance double, stddev double",
    )


def forecast_now(ticks: DataFrame, p: Params) -> DataFrame:
    """The latest forecast of each service; a service that fell silent keeps it."""
    newest = F.max_by(F.struct("forecast", "stddev"), "tick_no").alias("f")
    return forecast(ticks, p).groupBy("service").agg(newest).select("service", "f.forecast", "f.stddev")
