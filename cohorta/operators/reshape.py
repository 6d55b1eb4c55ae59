"""Long to wide and back, bins and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.columns import safe_ratio
from cohorta.operators.ranks import percentiles


def pivot_metrics(df: DataFrame, index: Sequence[str], column: str, values: Sequence, metrics: dict[str, Column]) -> DataFrame:
    """One column ``<metric>_<value>`` per metric and pivot value. Naming the values
    spares Spark a pass to find them."""
    wide = df.groupBy(*index).pivot(column, list(values)).agg(*[c.alias(m) for m, c in metrics.items()])
    if len(metrics) == 1:
        (only,) = metrics
        return wide.withColumnsRenamed({str(v): f"{only}_{v}" for v in values})
    return wide.withColumnsRenamed({f"{v}_{m}": f"{m}_{v}" for v in values for m in metrics})


def unpivot_metrics(df: DataFrame, index: Sequence[str], metrics: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row per metric; metrics are made double so that they share a column."""
    typed = df.select(*index, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(list(index), list(metrics), name, value)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    wide = df.groupBy(row).pivot(column, list(values)).count()
    return wide.fillna(0, [str(v) for v in values])


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, the last one closed.
    Every bin is listed: count, density (area 1) and share of rows so far."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    edges = known.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("_v").alias("n"))).scalar()
    place = F.floor((F.col("_v") - F.col("_e.lo")) / (F.col("_e.hi") - F.col("_e.lo")) * bins)
    binned = known.withColumn("_e", edges).withColumn(
        "bin", F.when(F.col("_e.hi") == F.col("_e.lo"), F.lit(0)).otherwise(F.least(place, F.lit(bins - 1))).cast("int")
    )
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    # A fixed, short list of bins; Spark may broadcast it, but nothing depends on that.
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(counts, "bin", "left").fillna(0, ["n"]).withColumn("_e", edges)
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    so_far = Window.partitionBy(F.lit(0)).orderBy("bin")
    return full.select(
        "bin",
        (F.col("_e.lo") + F.col("bin") * width).alias("bin_from"),
        (F.col("_e.lo") + (F.col("bin") + 1) * width).alias("bin_to"),
        "n",
        safe_ratio("n", F.col("_e.n") * width).alias("density"),
        safe_ratio(F.sum("n").over(so_far), F.col("_e.n")).alias("cumulative"),
    )


def smoothed_density(df: DataFrame, by: Sequence[str], value: str, points: int = 64, bins: int | None = 2_048, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density per group on ``points`` places from three bandwidths below the smallest value
    to three above the largest: by, point, x, density, bandwidth.

    Rows become weights on at most ``bins`` + 1 equally spaced places first, each value shared by its
    two neighbours in proportion, and only those are smoothed; ``bins=None`` takes the distinct values
    themselves, for columns with few. The bandwidth is 0.9 * min(standard deviation,
    quartile distance / 1.34) / n^(1/5) unless given. Nulls are left out, and so are groups of equal values
    (whose bandwidth is 0) unless one is given.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    stats = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_sd")]
    s = known.groupBy(*by).agg(*stats)
    if bandwidth is None:
        s = s.join(percentiles(known, by, "_v", {"_q1": 0.25, "_q3": 0.75}), list(by)) if by else s.crossJoin(percentiles(known, by, "_v", {"_q1": 0.25, "_q3": 0.75}))
        spread = F.when(F.col("_q3") > F.col("_q1"), F.least("_sd", (F.col("_q3") - F.col("_q1")) / 1.34)).otherwise(F.col("_sd"))
        s = s.withColumn("bandwidth", 0.9 * spread * F.pow("_n", F.lit(-0.2))).drop("_q1", "_q3")
    else:
        s = s.withColumn("bandwidth", F.lit(float(bandwidth)))
    s = s.where("bandwidth > 0").drop("_sd")
    keys = [*by, "_n", "_lo", "_hi", "bandwidth"]
    if bins is None:
        known = known.groupBy(*by, F.col("_v").alias("_at")).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    # With a shuffle of its own the small side is known by size at run time: it is broadcast or, with very
    # many groups, large groups are cut. Else all rows of a group would be sorted in one task.
    joined = known.join(s.repartition(*by), list(by)) if by else known.withColumn("_s", s.select(F.struct("*")).scalar()).select(*known.columns, "_s.*").where("_n is not null")
    if bins is None:
        weights = joined.select(*keys, "_at", "_w")
    else:
        width = (F.col("_hi") - F.col("_lo")) / bins
        place = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / width).otherwise(F.lit(0.0))
        left = F.floor(place)
        two = F.array(F.struct(left.alias("_k"), (1 - (place - left)).alias("_part")), F.struct((left + 1).alias("_k"), (place - left).alias("_part")))
        weights = joined.select(*keys, F.inline(two)).groupBy(*keys, "_k").agg(F.sum("_part").alias("_w"))
        weights = weights.withColumn("_at", F.col("_lo") + F.col("_k") * (F.col("_hi") - F.col("_lo")) / bins)
    # Every weight meets the places its kernel reaches: bins times points at most, whatever the rows.
    h = F.col("bandwidth")
    start, step = F.col("_lo") - 3 * h, (F.col("_hi") - F.col("_lo") + 6 * h) / (points - 1)
    first = F.greatest(F.ceil((F.col("_at") - 9 * h - start) / step), F.lit(0))
    last = F.least(F.floor((F.col("_at") + 9 * h - start) / step), F.lit(points - 1))
    reached = weights.withColumn("point", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("x", start + F.col("point") * step)
    z = (F.col("x") - F.col("_at")) / h
    height = F.sum(F.col("_w") * F.exp(-z * z / 2)) / (F.col("_n") * h * (2 * 3.141592653589793) ** 0.5)
    return reached.groupBy(*by, "point", "x", "bandwidth", "_n").agg(height.alias("density")).drop("_n")
