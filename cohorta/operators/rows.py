"""Row filters and one-row-per-key reductions.

"Keep the latest row per key" is written as an aggregate, not as ``row_number``:
an aggregate is combined on the map side, so a key with very many copies costs
one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.columns import all_of, col, hash_order


def current_rows(df: DataFrame, end: str) -> DataFrame:
    """Current versions of a slowly changing dimension."""
    return df.where(F.col(end).isNull())


def latest_snapshot(df: DataFrame, snapshot: str) -> DataFrame:
    """Rows of the newest snapshot."""
    newest = df.agg(F.max(snapshot)).scalar()
    return df.where(F.col(snapshot) == newest)


def customer_allowlist(df: DataFrame, allowed: DataFrame, key: str, conditions: Sequence[Column]) -> DataFrame:
    """Rows whose customer passes every condition of the customer table."""
    keep = allowed.where(all_of(conditions)).select(key).distinct()
    return df.join(keep, key, "left_semi")


def drop_all_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop every copy of a key that occurs more than once."""
    rest = [c for c in df.columns if c not in keys]
    # Only groups of one row are kept, so each column may be picked by itself; that
    # keeps the aggregate hash-based where the columns are numbers.
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in rest])
    return grouped.where(F.col("_copies") == 1).drop("_copies")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    return _pick(df, keys, order, F.min_by)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the largest ``order`` per key."""
    return _pick(df, keys, order, F.max_by)


def any_one_per_key(df: DataFrame, keys: Sequence[str], identity: Sequence[str], seed: str = "0") -> DataFrame:
    """One arbitrary row per key, the same one on every run."""
    return first_per_key(df, keys, [hash_order(*identity, seed=seed), *identity])


def _pick(df, keys, order, chooser):
    rest = [c for c in df.columns if c not in keys]
    position = F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order)])
    grouped = df.groupBy(*keys).agg(chooser(F.struct(*rest), position).alias("_row"))
    return grouped.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def keep_smallest_with_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows of a key that share its smallest value: ``rank() = 1``."""
    best = df.groupBy(*keys).agg(F.min(value).alias("_best"))
    on = all_of([df[k].eqNullSafe(best[k]) for k in keys] + [df[value] == best["_best"]])
    return df.join(best, on, "left_semi")


def collapse_first_values(df: DataFrame, keys: Sequence[str], firsts: dict[str, str]) -> DataFrame:
    """One row per key; every column takes its value from the earliest row by its
    own ordering column: ``firsts`` maps column -> ordering column."""
    picks = [F.min_by(c, F.struct(o, c)).alias(c) for c, o in firsts.items()]
    return df.groupBy(*keys).agg(*picks)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of nulls per column, in one pass."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def tidy(df: DataFrame, rename: dict[str, str] | None = None, drop: Sequence[str] = (), required: Sequence[str] = (), fill: dict | None = None) -> DataFrame:
    """Rename and drop columns, drop rows lacking required values, fill the rest."""
    out = df.dropna(subset=list(required)) if required else df
    out = out.fillna(fill) if fill else out
    return out.drop(*drop).withColumnsRenamed(rename or {})
