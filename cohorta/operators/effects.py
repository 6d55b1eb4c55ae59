"""Counterfactual effects beyond one straight line: several controls, and a level that moves.

Both work on short series, one row per key and day, that Spark has aggregated before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.columns import safe_ratio
from cohorta.functions.distributions import normal_quantile, normal_two_sided
from cohorta.functions.linear import RATIOS, local_level_rows, solve_rows


def _total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def controls_fit(series: DataFrame, keys: Sequence[str], treat: str, controls: Sequence[str], in_pre: Column) -> DataFrame:
    """Least squares of ``treat`` on the controls over the pre-period, per key, and its
    prediction for every row: adds predicted, fit_days, fit_noise (residual variance), fit_mean_<control> and
    fit_inverse (of the controls' centred sums of products, row after row).

    One aggregation makes all centred moments; the equations are solved on one row per key.
    Rows with a null in any of the columns are not fitted on. A control that those before it explain
    counts as absent. Fewer days than coefficients plus one leave the noise null.
    """
    controls, p = list(controls), len(controls)
    pre = series.where(in_pre).dropna(subset=[treat, *controls])
    n = F.count(F.lit(1))
    sums = [n.alias("fit_days"), F.avg(treat).alias("_mean"), (n * F.var_pop(treat)).alias("_own")]
    sums += [F.avg(c).alias(f"fit_mean_{c}") for c in controls]
    sums.append(F.array(*[n * F.covar_pop(a, b) for a in controls for b in controls]).alias("_gram"))
    sums.append(F.array(*[n * F.covar_pop(c, treat) for c in controls]).alias("_right"))
    fit = pre.groupBy(*keys).agg(*sums) if keys else pre.agg(*sums)
    fit = fit.withColumn("_solved", solve_rows("_gram", "_right"))
    left = F.col("_own") - _total([F.col("_solved.beta")[i] * F.col("_right")[i] for i in range(p)])
    fit = fit.withColumn("fit_noise", safe_ratio(F.greatest(left, F.lit(0.0)), F.when(F.col("fit_days") > p + 1, F.col("fit_days") - p - 1)))
    kept = ["fit_days", "fit_noise", *[f"fit_mean_{c}" for c in controls], "_mean", F.col("_solved.beta").alias("_beta"), F.col("_solved.inverse").alias("fit_inverse")]
    if keys:
        joined = series.join(fit.select(*keys, *kept), list(keys))
    else:
        joined = series.withColumn("_fit", fit.select(F.struct(*kept)).scalar()).select(*series.columns, "_fit.*")
    moved = _total([F.col("_beta")[i] * (F.col(c) - F.col(f"fit_mean_{c}")) for i, c in enumerate(controls)])
    return joined.withColumn("predicted", F.col("_mean") + moved).drop("_mean", "_beta")


def _effects(out: DataFrame, keys: Sequence[str], day: str, treat: str, confidence: float) -> DataFrame:
    """Adds effect, its running total, the relative effect so far, and with ``standard_error`` of the total
    its interval and p-value."""
    spec = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(day)
    out = out.withColumn("effect", F.col(treat) - F.col("predicted"))
    out = out.withColumn("cumulative_effect", F.sum("effect").over(spec))
    out = out.withColumn("relative_effect", safe_ratio("cumulative_effect", F.sum("predicted").over(spec)))
    half = F.lit(normal_quantile(0.5 + confidence / 2)) * F.col("standard_error")
    out = out.withColumn("cumulative_lower", F.col("cumulative_effect") - half).withColumn("cumulative_upper", F.col("cumulative_effect") + half)
    return out.withColumn("p_value", normal_two_sided(safe_ratio("cumulative_effect", "standard_error")))


def counterfactual_with_controls(
    series: DataFrame, keys: Sequence[str], day: str, treat: str, controls: Sequence[str], in_pre: Column, in_post: Column, confidence: float = 0.95
) -> DataFrame:
    """Effect per post-period day against a prediction from several controls.

    The total of k days scatters by s^2 * (k + k^2 / n + g' C^-1 g): the days' own noise, that of
    the mean, and that of the coefficients, where g is the sum of the controls' distances from
    their pre-period means and C their centred sums of products.
    """
    fitted = controls_fit(series, keys, treat, controls, in_pre).where(in_post).dropna(subset=[treat, *controls])
    spec = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(day)
    away = {f"_away_{i}": F.sum(F.col(c) - F.col(f"fit_mean_{c}")).over(spec) for i, c in enumerate(controls)}
    out = fitted.withColumns({"_days": F.count(F.lit(1)).over(spec), **away})
    p = len(controls)
    spread = _total([F.col("fit_inverse")[i * p + j] * F.col(f"_away_{i}") * F.col(f"_away_{j}") for i in range(p) for j in range(p)])
    variance = F.col("fit_noise") * (F.col("_days") + F.col("_days") * F.col("_days") / F.col("fit_days") + spread)
    out = out.withColumn("standard_error", F.sqrt(variance)).drop("_days", *away)
    return _effects(out, keys, day, treat, confidence)


def local_level_effect(
    series: DataFrame, keys: Sequence[str], day: str, treat: str, controls: Sequence[str], in_pre: Column, in_post: Column,
    ratios: Sequence[float] = RATIOS, refine: bool = True, confidence: float = 0.95,
) -> DataFrame:
    """Effect per post-period day against a level that moves: treat = level + controls + noise, the level
    a random walk. Its variance relative to the noise's is the likeliest of ``ratios``, then sought between
    the neighbours with ``refine``. The filter runs over the days before the cut; after it the
    forecast stays on the last level, and its error grows day by day.

    Rows are one per key and day and count as equally far apart: put a spine under series with
    gaps. A null value before the cut is bridged. Adds predicted, prediction_error (of one
    day), standard_error (of the running total), noise_variance and level_ratio to ``effect`` and its total.
    """
    marked = series.where(in_pre | in_post).withColumn("_pre", F.when(in_pre, 1.0).otherwise(0.0))
    nan = F.lit(float("nan"))
    xs = F.array(*[F.coalesce(F.col(c).cast("double"), nan) for c in controls]) if controls else F.array().cast("array<double>")
    row = F.struct(F.col(day).alias("day"), F.coalesce(F.col(treat).cast("double"), nan).alias("y"), xs.alias("x"), F.col("_pre").alias("pre"))
    # One row per series, as long as the period.
    lists = F.sort_array(F.collect_list(row)).alias("_rows")
    one = marked.groupBy(*keys).agg(lists) if keys else marked.agg(lists)
    one = one.where(F.size("_rows") > 0)
    part = lambda name: F.transform("_rows", lambda r: r[name])
    one = one.withColumn("_level", local_level_rows(tuple(ratios), refine)(part("y"), F.flatten(part("x")), part("pre")))
    days = F.arrays_zip(part("day").alias(day), F.col("_level.predicted").alias("predicted"), F.col("_level.error").alias("prediction_error"), F.col("_level.cumulative_error").alias("standard_error"))
    long = one.select(*keys, F.col("_level.noise_variance").alias("noise_variance"), F.col("_level.level_ratio").alias("level_ratio"), F.inline(days))
    out = series.where(in_post).join(long, [*keys, day]).where(F.col(treat).isNotNull() & F.col("predicted").isNotNull())
    return _effects(out, keys, day, treat, confidence)
