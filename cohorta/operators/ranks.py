"""Ranks, percentiles and shares over groups of any size.

They start from a value table: one row per (group, value) with its count. Equal
values collapse on the map side, and only that table is scanned in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.columns import all_of, safe_ratio
from cohorta.operators.scans import GROUP_LIMIT, group_sizes, ordered_scans, running_sum
from cohorta.session import ensure_checkpoint_dir


def value_table(df: DataFrame, group: Sequence[str], value: str, *, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Per group and distinct non-null value: ``n`` copies, ``upto`` rows up to and
    including it, ``dense`` its dense rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    counts = _kept(counts).withColumn("_one", F.lit(1).cast("long"))
    scans = {"upto": running_sum("n"), "dense": running_sum("_one")}
    return ordered_scans(counts, group, [value], scans, group_limit=group_limit).drop("_one")


def _kept(df: DataFrame) -> DataFrame:
    """An aggregate that several steps read, written down once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _totals(table: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    return table.groupBy(*group).agg(F.sum("n").alias(name))


def _attach(df: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add the columns of a frame with one row per ``on``; null keys match."""
    if not on:
        added = small.columns
        one = df.withColumn("_row", small.select(F.struct(*added)).scalar())
        return one.select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in added])
    right = small.withColumnsRenamed({c: f"_r_{c}" for c in on})
    match = all_of([df[c].eqNullSafe(right[f"_r_{c}"]) for c in on])
    return df.join(right, match).drop(*[f"_r_{c}" for c in on])


def ranked(df: DataFrame, group: Sequence[str], value: str, *, descending: bool = False, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Add ``rank_min``, ``rank_dense``, ``rank_avg`` and ``rank_percent`` of ``value``
    within its group. Rows with a null value are left out."""
    sign = -1 if descending else 1
    keyed = df.withColumn("_v", F.col(value) * sign)
    table = value_table(keyed, group, "_v", group_limit=group_limit)
    table = _attach(table, _totals(table, group, "_total"), group)
    first = F.col("upto") - F.col("n") + 1
    table = table.select(
        *group,
        "_v",
        first.alias("rank_min"),
        F.col("dense").alias("rank_dense"),
        (first + (F.col("n") - 1) / 2).alias("rank_avg"),
        F.when(F.col("_total") == 1, F.lit(0.0)).otherwise((first - 1) / (F.col("_total") - 1)).alias("rank_percent"),
    )
    return _attach(keyed, table, [*group, "_v"]).drop("_v")


def percentiles(df: DataFrame, group: Sequence[str], value: str, points: dict[str, float], *, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Exact percentiles per group, interpolated linearly; ``points``: name -> fraction.

    ``percentile`` keeps every distinct value of a group in one task's memory, so it
    is used only while groups are small; larger ones are read off the value table, by the
    same arithmetic. A group without known values has null percentiles.
    """
    largest = group_sizes(df, group).agg(F.max("_size")).first()[0] or 0
    if largest <= group_limit:
        both = df.groupBy(*group).agg(F.percentile(value, list(points.values())).alias("_p"))
        return both.select(*group, *[F.col("_p")[i].alias(n) for i, n in enumerate(points)])
    table = value_table(df, group, value, group_limit=group_limit)
    table = _attach(table, _totals(table, group, "_total"), group)
    below = F.col("upto") - F.col("n")
    picks = []
    for name, p in points.items():
        place = (F.col("_total") - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (below <= index) & (index < F.col("upto"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        picks.append(F.max(F.ceil(place) - place).alias(f"_{name}_wlo"))
        picks.append(F.max(place - F.floor(place)).alias(f"_{name}_whi"))
    found = table.groupBy(*group).agg(*picks)
    between = {n: F.col(f"_{n}_wlo") * F.col(f"_{n}_lo") + F.col(f"_{n}_whi") * F.col(f"_{n}_hi") for n in points}
    same = {n: F.col(f"_{n}_lo") == F.col(f"_{n}_hi") for n in points}
    found = found.select(*group, *[F.when(same[n], F.col(f"_{n}_lo")).otherwise(between[n]).alias(n) for n in points])
    if not group:
        return found
    everyone = df.select(*[F.col(g).alias(f"_g_{g}") for g in group]).distinct()
    match = all_of([everyone[f"_g_{g}"].eqNullSafe(found[g]) for g in group])
    return everyone.join(found, match, "left").select(*[F.col(f"_g_{g}").alias(g) for g in group], *points)


def box_stats(df: DataFrame, group: Sequence[str], value: str, *, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR) and number of outliers."""
    quartiles = percentiles(df, group, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group_limit=group_limit)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = _attach(df.where(F.col(value).isNotNull()), quartiles, group)
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(*group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def cumulative_share(df: DataFrame, label: str, weight: str, *, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Pareto table: heaviest first, with each row's share and the share so far (percent)."""
    kept = _kept(df)  # read for the total and for the shares
    total = kept.agg(F.sum(weight)).scalar()
    shares = kept.withColumn("share", 100 * safe_ratio(weight, total)).withColumn("_down", -F.col(weight))
    # Sums of decimals do not depend on the order in which parts are added.
    shares = shares.withColumn("_exact", F.col("share").cast("decimal(28,18)"))
    out = ordered_scans(shares, [], ["_down", label], {"cumulative_share": running_sum("_exact")}, group_limit=group_limit)
    return out.withColumn("cumulative_share", F.col("cumulative_share").cast("double")).drop("_down", "_exact")


def share_of_total(df: DataFrame, value: str, within: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Value over the sum of its group, or of everything."""
    if not within:
        return df.withColumn(name, safe_ratio(value, df.agg(F.sum(value)).scalar()))
    sums = df.groupBy(*within).agg(F.sum(value).alias("_sum"))
    return _attach(df, sums, within).withColumn(name, safe_ratio(value, "_sum")).drop("_sum")


def average_rank_correlation(df: DataFrame, x: str, y: str, *, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Spearman: Pearson correlation of average ranks. Rows shrink to distinct (x, y) pairs
    with counts before anything is ranked; the correlation is then a weighted one."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("_w"))
    pairs = _kept(pairs)

    def ranks_of(column, name):
        counts = pairs.groupBy(column).agg(F.sum("_w").alias("n"))
        table = ordered_scans(counts, [], [column], {"upto": running_sum("n")}, group_limit=group_limit)
        return table.select(F.col(column).alias(f"_v{name}"), (F.col("upto") - (F.col("n") - 1) / 2).alias(name))

    ranked_pairs = pairs.join(ranks_of(x, "_rx"), F.col(x) == F.col("_v_rx")).join(ranks_of(y, "_ry"), F.col(y) == F.col("_v_ry"))
    w = F.col("_w").cast("double")
    mean = lambda e: F.sum(w * e) / F.sum(w)
    a, b = F.col("_rx"), F.col("_ry")
    covariance = mean(a * b) - mean(a) * mean(b)
    spread = F.sqrt((mean(a * a) - mean(a) * mean(a)) * (mean(b * b) - mean(b) * mean(b)))
    return ranked_pairs.agg(F.try_divide(covariance, spread).alias("spearman"))


def top_k(df: DataFrame, by: str, label: str, k: int) -> DataFrame:
    """The k largest rows; the label breaks ties."""
    return df.orderBy(F.col(by).desc(), F.col(label)).limit(k)


def rolling_mean(df: DataFrame, keys: Sequence[str], day: str, value: str, size: int, min_rows: int, name: str = "rolling_mean") -> DataFrame:
    """Mean over the last ``size`` rows of a daily series; null before ``min_rows``.
    Input has one row per day and key, so a group is as long as the period."""
    spec = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(day)
    frame = spec.rowsBetween(-(size - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(frame) >= min_rows, F.avg(value).over(frame)))


def first_difference(df: DataFrame, keys: Sequence[str], day: str, value: str, name: str = "difference") -> DataFrame:
    """Change since the day before in a daily series."""
    spec = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(day)
    return df.withColumn(name, F.col(value) - F.lag(value).over(spec))


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Running total of an already aggregated series (one row per key and period)."""
    spec = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order)
    return df.withColumn(name, F.sum(value).over(spec))


