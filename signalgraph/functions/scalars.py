"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalgraph.schema import ERROR_LEVELS, LEVEL_STATUS, LEVELS, PROBLEM_LEVELS, SERVICE_GROUPS

# fixed values: parts of a message that vary from line to line
PARAMETER_PATTERN = (
    r"[a-f0-9]{6,}|sku_[a-zA-Z0-9]+|u_[0-9]+|id_[a-f0-9]+|p_[0-9]+|sess_[a-zA-Z0-9]+|[0-9]+(?:\.[0-9]+)?"
)
PLACEHOLDER = "<*>"
# Unicode white space plus the four separators U+001C..U+001F
BLANKS = r"(?U)[\s\x1c-\x1f]+"


def is_error(level="level") -> Column:
    return F.col(level).isin(ERROR_LEVELS)


def is_problem(level="level") -> Column:
    return F.col(level).isin(PROBLEM_LEVELS)


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("bigint")


def ratio(part, whole) -> Column:
    """``part / whole`` as a double, 0 where ``whole`` is 0."""
    part, whole = _col(part), _col(whole)
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def per_minute(total, window_s: float) -> Column:
    return _col(total).cast("double") / F.lit(max(window_s / 60.0, 1e-6))


def health(error_rate, p95) -> Column:
    """1 is healthy; errors weigh 1.8 and latency costs at most 0.6."""
    return F.greatest(
        F.lit(0.0),
        1.0 - _col(error_rate) * 1.8 - F.least(_col(p95) / 800.0, F.lit(0.6)),
    )


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def z_severity(z, threshold: float) -> Column:
    return clip((_col(z) - threshold) / 6.0 + 0.5)


def outlier_severity(decision) -> Column:
    return clip(0.5 - _col(decision))


def rule_severity(fired_count) -> Column:
    """``fired_count`` already counts the firing being scored."""
    return F.least(F.lit(0.95), 0.55 + _col(fired_count) * 0.05)


def bucket_index(ts, width_s: float) -> Column:
    return F.floor(_col(ts) / F.lit(float(width_s)))


def mask(message) -> Column:
    return F.regexp_replace(_col(message), PARAMETER_PATTERN, PLACEHOLDER)


def tokens(text) -> Column:
    """Words of ``text``; an all-blank text has none."""
    return F.filter(F.split(_col(text), BLANKS), lambda w: w != "")


def status_of(level="level") -> Column:
    pairs = [F.lit(x) for item in LEVEL_STATUS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(200))


def group_of(service="service") -> Column:
    pairs = [F.lit(x) for item in SERVICE_GROUPS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(service)), F.lit("other"))


def level_rank(level="level") -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col(level))


def short_id(prefix: str, *parts) -> Column:
    """Repeatable id: the same natural key gives the same id on every replay."""
    key = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 16))


def signed(value, digits: int) -> Column:
    """Number text with an explicit sign, e.g. ``+0.12``."""
    return F.format_string(f"%+.{digits}f", _col(value))


def tone(value, bad: float, warn: float | None = None) -> Column:
    out = F.when(_col(value) > bad, "bad")
    if warn is not None:
        out = out.when(_col(value) > warn, "warn")
    return out.otherwise("good")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
