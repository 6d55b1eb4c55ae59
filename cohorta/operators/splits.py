"""Assignment to groups, search for a good split, and counterfactual effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.columns import bucket_variant, hash_bucket, safe_ratio
from cohorta.functions.distributions import normal_quantile, normal_two_sided
from cohorta.operators.simulation import split_sums
from cohorta.session import ensure_checkpoint_dir


def assign_by_hash(df: DataFrame, unit: str, salt: str, bounds: Sequence[tuple[int, str]], buckets: int = 1000, name: str = "variant") -> DataFrame:
    """Variant from a salted hash of the unit; ``bounds`` are (exclusive upper bucket, name)."""
    return df.withColumn(name, bucket_variant(hash_bucket(unit, salt, buckets), bounds))


def assign_nested(df: DataFrame, unit: str, salts: Sequence[str], shares: Sequence[float], labels: Sequence[tuple[str, str]]) -> DataFrame:
    """Nested assignment, each level drawn apart within the second label of the level
    above: hold-out or not, then experiment or not, then control or variant."""
    result: Column | None = None
    for salt, share, (kept, rest) in reversed(list(zip(salts, shares, labels))):
        inner = F.lit(rest) if result is None else result
        result = F.when(hash_bucket(unit, salt) < F.lit(int(share * 1000)), F.lit(kept)).otherwise(inner)
    return df.withColumn("group", result)


def daily_series(df: DataFrame, keys: Sequence[str], day: str, group: str, value: str, treat: str, control: str) -> DataFrame:
    """One row per key and day with treat and control side by side; days lacking one are dropped."""
    side = lambda g: F.sum(F.when(F.col(group) == g, F.col(value)))
    return df.groupBy(*keys, day).agg(side(treat).alias("treat"), side(control).alias("control")).dropna(subset=["treat", "control"])


def pre_period_fit(series: DataFrame, keys: Sequence[str], in_pre: Column) -> DataFrame:
    """Straight line of treat on control over the pre-period, and the prediction for
    every day. One row per key is joined back to one row per key and day."""
    pre = series.where(in_pre)
    line = [
        F.regr_slope("treat", "control").alias("slope"),
        F.regr_intercept("treat", "control").alias("intercept"),
        F.regr_count("treat", "control").alias("fit_days"),
        F.regr_avgx("treat", "control").alias("fit_mean"),
        F.regr_sxx("treat", "control").alias("fit_sxx"),
        (F.regr_syy("treat", "control") - F.pow(F.regr_sxy("treat", "control"), 2) / F.regr_sxx("treat", "control")).alias("fit_sse"),
    ]
    if not keys:
        fit = pre.agg(F.struct(*line)).scalar()
        joined = series.withColumn("_fit", fit).select(*series.columns, "_fit.*")
    else:
        joined = series.join(pre.groupBy(*keys).agg(*line), list(keys))
    return joined.withColumn("predicted", F.col("intercept") + F.col("slope") * F.col("control"))


def counterfactual_effect(series: DataFrame, keys: Sequence[str], day: str, in_pre: Column, in_post: Column, confidence: float = 0.95) -> DataFrame:
    """Effect per post-period day, its running total and the relative effect so far, with
    an interval and a p-value for the total.

    The total of k days scatters by the k days' own noise and by that of the fitted line:
    s^2 * (k + k^2 / n + (sum of (x - mean x))^2 / sxx), s^2 being the residual variance of
    the n pre-period days. The normal quantile stands for Student's.
    """
    fitted = pre_period_fit(series, keys, in_pre).where(in_post)
    out = fitted.withColumn("effect", F.col("treat") - F.col("predicted"))
    # A daily series: groups are as long as the post-period.
    spec = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(day)
    out = out.withColumn("cumulative_effect", F.sum("effect").over(spec))
    out = out.withColumn("relative_effect", safe_ratio("cumulative_effect", F.sum("predicted").over(spec)))
    days, away = F.count(F.lit(1)).over(spec), F.sum(F.col("control") - F.col("fit_mean")).over(spec)
    noise = safe_ratio(F.greatest("fit_sse", F.lit(0.0)), F.col("fit_days") - 2)
    out = out.withColumn("standard_error", F.sqrt(noise * (days + days * days / F.col("fit_days") + safe_ratio(away * away, F.col("fit_sxx")))))
    half = F.lit(normal_quantile(0.5 + confidence / 2)) * F.col("standard_error")
    out = out.withColumn("cumulative_lower", F.col("cumulative_effect") - half).withColumn("cumulative_upper", F.col("cumulative_effect") + half)
    return out.withColumn("p_value", normal_two_sided(safe_ratio("cumulative_effect", "standard_error")))


def mase(fitted: DataFrame, keys: Sequence[str], day: str, period: str) -> DataFrame:
    """Mean absolute error of the prediction over the mean absolute day-on-day change,
    per key and period; differences do not reach across periods."""
    spec = Window.partitionBy(*keys, period).orderBy(day)
    moved = fitted.withColumn("_step", F.abs(F.col("treat") - F.lag("treat").over(spec)))
    return moved.groupBy(*keys, period).agg(
        safe_ratio(F.avg(F.abs(F.col("treat") - F.col("predicted"))), F.avg("_step")).alias("mase")
    )


def split_search(
    store_days: DataFrame, store: str, day: str, metrics: Sequence[str], n_splits: int, treat_share: float, in_pre: Column, salt: str = "split",
) -> DataFrame:
    """Try ``n_splits`` random splits of the stores and rank them by how well control
    predicts treat: MASE over the pre-period, dense rank per metric, ranks summed,
    ties by split number.

    One pass over the store-days makes the sums of all splits; the (split, day) table is written down once, as
    the fit and its errors both read it.
    """
    ensure_checkpoint_dir(store_days.sparkSession)
    per_day = split_sums(store_days, store, day, list(metrics), n_splits, treat_share, salt).checkpoint()
    long = per_day.select(
        "split", day,
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"t_{m}").alias("treat"), F.col(f"c_{m}").alias("control")) for m in metrics])),
    ).dropna(subset=["treat", "control"])
    fitted = pre_period_fit(long, ["split", "metric"], in_pre).where(in_pre).withColumn("period", F.lit("pre"))
    scores = mase(fitted, ["split", "metric"], day, "period")
    # One row per split and metric from here on. Scores that differ only in how their sums
    # were rounded share a rank.
    ranked = scores.withColumn("rank", F.dense_rank().over(Window.partitionBy("metric").orderBy(F.round("mase", 9))))
    total = ranked.groupBy("split").agg(
        F.sum("rank").alias("total_rank"),
        *[F.max(F.when(F.col("metric") == m, F.col("mase"))).alias(f"mase_{m}") for m in metrics],
    )
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("total_rank", "split")) == 1
    return total.withColumn("is_best", best)


def linear_regression(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Straight line of y on x per group."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("pearson")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}__{b}").alias("pearson")) for a, b in pairs]))
    )


def cumulative_difference(df: DataFrame, keys: Sequence[str], day: str, group: str, value: str, treat: str, control: str) -> DataFrame:
    """Running sum over days of treat minus control."""
    side = lambda g: F.coalesce(F.sum(F.when(F.col(group) == g, F.col(value))), F.lit(0.0))
    daily = df.groupBy(*keys, day).agg((side(treat) - side(control)).alias("difference"))
    spec = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(day)
    return daily.withColumn("cumulative_difference", F.sum("difference").over(spec))
