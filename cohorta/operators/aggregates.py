"""Aggregates that stay right after joins, and many distinct counts at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.columns import all_of, safe_ratio


def conditional_distinct(df: DataFrame, by: Sequence[str], key: str | Sequence[str], conditions: dict[str, Column], extra: dict[str, Column] | None = None) -> DataFrame:
    """``count(distinct case when condition then key end)`` for many conditions at once.

    Rows shrink to one per group and key, carrying a flag per condition. Asking for the
    counts directly would copy every input row once per condition. A composite key is a
    list of columns and counts only where none of them is null. ``extra`` are plain sums
    taken along.
    """
    keys = [key] if isinstance(key, str) else list(key)
    extra = extra or {}
    present = all_of([F.col(k).isNotNull() for k in keys])
    flags = [F.max(F.coalesce(c, F.lit(False)) & present).alias(f"_f_{n}") for n, c in conditions.items()]
    sums = [F.sum(c).alias(f"_s_{n}") for n, c in extra.items()]
    per_key = df.groupBy(*by, *[k for k in keys if k not in by]).agg(*flags, *sums)
    return per_key.groupBy(*by).agg(
        *[F.count_if(f"_f_{n}").alias(n) for n in conditions],
        *[F.sum(f"_s_{n}").alias(n) for n in extra],
    )


def once_per_key(df: DataFrame, by: Sequence[str], key: Sequence[str], value: str) -> DataFrame:
    """One value per group and key, undoing the repetition a join caused."""
    return df.groupBy(*by, *[k for k in key if k not in by]).agg(F.max(value).alias(value))


def fanout_safe_sum(df: DataFrame, by: Sequence[str], key: Sequence[str], value: str, name: str = "total") -> DataFrame:
    """Sum that takes each key once, however often a join has repeated it."""
    total = F.coalesce(F.sum(value), F.lit(0)).alias(name)
    return once_per_key(df, by, key, value).groupBy(*by).agg(total)


def fanout_safe_avg(df: DataFrame, by: Sequence[str], key: Sequence[str], value: str, name: str = "average") -> DataFrame:
    """That sum over the number of distinct keys that have a value; null without any."""
    return once_per_key(df, by, key, value).groupBy(*by).agg(F.avg(value).alias(name))


def grain_audit(df: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows beside distinct keys; equal numbers prove one row per key."""
    per_key = df.groupBy(*by, *[k for k in key if k not in by]).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")
    )


def assert_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise if a key occurs twice."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"not one row per {list(key)}: {repeated}")
    return df


def ratio_of_sums(df: DataFrame, by: Sequence[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """``sum(numerator) / sum(denominator)`` per group."""
    needed = sorted({c for pair in ratios.values() for c in pair})
    sums = df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in needed])
    return sums.select(*by, *[safe_ratio(n, d).alias(name) for name, (n, d) in ratios.items()])


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    weighted = F.sum(F.col(value) * F.col(weight))
    return df.groupBy(*by).agg(safe_ratio(weighted, F.sum(weight)).alias("weighted_mean"), F.avg(value).alias("plain_mean"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", safe_ratio("n", total))
