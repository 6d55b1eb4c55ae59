"""Do two sources hold the same rows?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with its row count on both sides. One aggregation over both sources
    in place of a full outer join: each side is counted before the shuffle, and null
    keys come out like any other."""
    a = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    b = right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    both = a.unionByName(b).groupBy(*keys).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    side = F.when(F.col("n_right") == 0, "left only").when(F.col("n_left") == 0, "right only").otherwise("both")
    return both.withColumn("side", side)


def reconcile_counts(sources: dict[str, DataFrame], by: Sequence[str]) -> DataFrame:
    """The same count from several systems, side by side per group."""
    tagged = None
    for name, df in sources.items():
        part = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_source", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = [
        F.coalesce(F.sum(F.when(F.col("_source") == name, F.col("_n"))), F.lit(0)).alias(f"n_{name}")
        for name in sources
    ]
    return tagged.groupBy(*by).agg(*counts)


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the left source that the right one lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")
