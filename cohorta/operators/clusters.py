"""Comparison of variants where the unit of analysis (an order, a session) is finer than the
unit that varies independently (a customer), and of weighted combinations of metrics.

A mean's error comes from influence values: how much each row moves the mean. They are
summed per cluster before squaring, so rows of one cluster may go together in any way,
also across variants. Per cluster only counts and sums per variant and metric are needed;
one aggregation over the clusters gives their covariances, and every error is a quadratic
form of those.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.columns import safe_ratio
from cohorta.functions.distributions import normal_quantile, normal_two_sided, student_t_two_sided
from cohorta.operators.scans import LONE, lone_nulls

_SIDES = ("c", "v")


def _moments(df: DataFrame, by: Sequence[str], metrics: Sequence[str], cluster: str, variant: str, control: str, treatment: str) -> tuple[DataFrame, list[str]]:
    """Per group: number of clusters, totals of each metric's count and sum by variant, and their
    covariances over the clusters. A row with an unknown cluster is a cluster of its own."""
    rows = lone_nulls(df.where(F.col(variant).isin(control, treatment)), [cluster])
    names, made = [], []
    for i, m in enumerate(metrics):
        for side, v in zip(_SIDES, (control, treatment)):
            x = F.when(F.col(variant) == v, F.col(m).cast("double"))
            names += [f"n{i}{side}", f"s{i}{side}"]
            made += [F.count(x).cast("double").alias(f"n{i}{side}"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{i}{side}")]
    clusters = rows.groupBy(*by, cluster, LONE).agg(*made)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    stats = [F.count(F.lit(1)).alias("n_clusters"), *[F.sum(a).alias(a) for a in names], *[F.covar_samp(a, b).alias(f"{a}_{b}") for a, b in pairs]]
    return clusters.groupBy(*by).agg(*stats), names


def _variance(names: Sequence[str], loads: dict[str, Column]) -> Column:
    """Clusters times the variance of the loads' sum: the influence values' sum of squares, with the
    factor clusters / (clusters - 1)."""
    place = {a: k for k, a in enumerate(names)}
    parts = []
    for a in loads:
        for b in loads:
            first, second = (a, b) if place[a] <= place[b] else (b, a)
            parts.append(loads[a] * loads[b] * F.col(f"{first}_{second}"))
    return F.greatest(F.col("n_clusters") * reduce(lambda x, y: x + y, parts), F.lit(0.0))


def _loads(i: int, relative: bool) -> dict[str, Column]:
    """Effect of metric i (difference of means, or ratio less one) as a linear form of counts and sums around their totals."""
    nc, nv = F.col(f"n{i}c"), F.col(f"n{i}v")
    mc, mv = safe_ratio(f"s{i}c", nc), safe_ratio(f"s{i}v", nv)
    on_v, on_c = (safe_ratio(F.lit(1.0), mc), safe_ratio(mv, mc * mc)) if relative else (F.lit(1.0), F.lit(1.0))
    return {f"n{i}c": on_c * mc / nc, f"s{i}c": -on_c / nc, f"n{i}v": -on_v * mv / nv, f"s{i}v": on_v / nv}


def clustered_test(
    df: DataFrame, by: Sequence[str], metrics: Sequence[str], cluster: str, variant: str, control: str, treatment: str, alpha: float = 0.05
) -> DataFrame:
    """Difference of means over rows for every metric, with a cluster-robust error: one row per group
    and metric. Null values of a metric are left out; p is Student's with clusters - 1 degrees of freedom."""
    wide, names = _moments(df, by, metrics, cluster, variant, control, treatment)
    rows = []
    for i, m in enumerate(metrics):
        mc, mv = safe_ratio(f"s{i}c", f"n{i}c"), safe_ratio(f"s{i}v", f"n{i}v")
        rows.append(F.struct(
            F.lit(m).alias("metric"), F.col(f"n{i}c").cast("long").alias("n_control"), F.col(f"n{i}v").cast("long").alias("n_variant"),
            mc.alias("mean_control"), mv.alias("mean_variant"), (mv - mc).alias("difference"), F.sqrt(_variance(names, _loads(i, False))).alias("standard_error"),
        ))
    out = wide.select(*by, "n_clusters", F.inline(F.array(*rows)))
    out = out.withColumn("t_statistic", safe_ratio("difference", "standard_error"))
    p = student_t_two_sided("t_statistic", (F.col("n_clusters") - 1).cast("double"))
    out = out.withColumn("p_value", F.when(F.col("t_statistic").isNotNull() & (F.col("n_clusters") > 1), p))
    return out.withColumn("is_significant", F.col("p_value") <= alpha)


def composite_effect(
    df: DataFrame, by: Sequence[str], weights: dict[str, float], cluster: str, variant: str, control: str, treatment: str, relative: bool = True, confidence: float = 0.9
) -> DataFrame:
    """A weighted sum of several metrics' effects (relative ones, or differences of means) with the
    error that their covariance gives it: one row per group. Weights come from wherever the
    long-term metric was fitted."""
    metrics = list(weights)
    wide, names = _moments(df, by, metrics, cluster, variant, control, treatment)
    loads: dict[str, Column] = {}
    effects = []
    for i, m in enumerate(metrics):
        w = F.lit(float(weights[m]))
        loads |= {a: w * x for a, x in _loads(i, relative).items()}
        mc, mv = safe_ratio(f"s{i}c", f"n{i}c"), safe_ratio(f"s{i}v", f"n{i}v")
        effects.append((safe_ratio(mv, mc) - 1 if relative else mv - mc).alias(f"effect_{m}"))
    total = reduce(lambda x, y: x + y, [F.lit(float(weights[m])) * F.col(f"effect_{m}") for m in metrics])
    out = wide.select(*by, "n_clusters", *effects, F.sqrt(_variance(names, loads)).alias("standard_error")).withColumn("composite", total)
    half = F.lit(normal_quantile(0.5 + confidence / 2)) * F.col("standard_error")
    out = out.withColumn("lower", F.col("composite") - half).withColumn("upper", F.col("composite") + half)
    return out.withColumn("p_value", normal_two_sided(safe_ratio("composite", "standard_error")))
