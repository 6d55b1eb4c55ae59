"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def case_map(rules, default=None) -> Column:
    """First matching rule wins; ``rules`` is a list of (condition, label)."""
    (first, label), *rest = rules
    expr = F.when(first, F.lit(label))
    for condition, value in rest:
        expr = expr.when(condition, F.lit(value))
    return expr.otherwise(F.lit(default))


def threshold_label(value, uppers, labels) -> Column:
    """Label of the first upper bound the value does not exceed.

    ``labels`` has one entry per bound and may have one more for values above
    the last bound.
    """
    v = col(value)
    rules = [(v <= F.lit(u), name) for u, name in zip(uppers, labels)]
    rest = labels[len(uppers)] if len(labels) > len(uppers) else None
    return F.when(v.isNotNull(), case_map(rules, rest))


def fixed_bins(value, edges, labels, missing) -> Column:
    """Right-closed bins whose lowest edge is included; anything else is ``missing``."""
    v = col(value)
    rules = [((v > lo) & (v <= hi), name) for lo, hi, name in zip(edges, edges[1:], labels)]
    return F.when(v == F.lit(edges[0]), F.lit(labels[0])).otherwise(case_map(rules, missing))


def safe_ratio(numerator, denominator) -> Column:
    """Ratio as double; null for a zero or null denominator."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def known_alive(deleted) -> Column:
    """True only where the flag says "not deleted"; null counts as deleted."""
    return ~F.coalesce(col(deleted), F.lit(True))


def not_known_deleted(deleted) -> Column:
    """True unless the flag says "deleted"; null counts as alive."""
    return ~F.coalesce(col(deleted), F.lit(False))


def within_closed(value, start, end) -> Column:
    return col(value).between(col(start), col(end))


def within_half_open(value, start, end) -> Column:
    return (col(value) >= col(start)) & (col(value) < col(end))


def seconds_between(start, end) -> Column:
    """Whole seconds elapsed."""
    return F.timestamp_diff("SECOND", col(start), col(end))


def tenure_periods(first_day, day, period_days: int = 28) -> Column:
    """Full periods between two dates."""
    days = F.datediff(col(day), col(first_day))
    return F.floor(days / F.lit(period_days)).cast("long")


def hash_bucket(unit, salt: str | Column, buckets: int = 1000) -> Column:
    """Repeatable bucket of a unit: the same id and salt always give the same one."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.md5(F.concat(salt.cast("string"), col(unit).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(buckets)


def bucket_variant(bucket, bounds) -> Column:
    """Variant by bucket; ``bounds`` is a list of (exclusive upper bucket, name)."""
    b = col(bucket)
    return case_map([(b < F.lit(upper), name) for upper, name in bounds])


def hash_order(*cols, seed: str = "0") -> Column:
    """Stand-in for a random sort key that gives the same order on every run."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[col(c).cast("string") for c in cols]))


def iso_weekday(day) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(col(day)) + 1


def month_key(day) -> Column:
    return F.date_format(col(day), "yyyy-MM")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
