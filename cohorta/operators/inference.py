"""A/B inference from moments.

Every test needs only counts, sums and sums of squares per group, which Spark makes
in one aggregation for all groups and metrics. The tail probability is then added on
one row per test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.functions.columns import safe_ratio
from cohorta.functions.distributions import (
    chi_square_upper,
    detectable_shift,
    exact_power,
    normal_quantile,
    normal_cdf,
    normal_two_sided,
    student_t_two_sided,
)


def _welch(out: DataFrame, alpha: float, p_factor: int | Column = 1) -> DataFrame:
    """From n_/mean_/var_ of control and variant: t, degrees of freedom, p, verdict.
    A group of one value has no variance, hence no p and no verdict."""
    vc = safe_ratio("var_control", "n_control")
    vv = safe_ratio("var_variant", "n_variant")
    t = safe_ratio(F.col("mean_control") - F.col("mean_variant"), F.sqrt(vc + vv))
    df = safe_ratio(
        F.pow(vc + vv, 2), safe_ratio(F.pow(vc, 2), F.col("n_control") - 1) + safe_ratio(F.pow(vv, 2), F.col("n_variant") - 1)
    )
    out = out.withColumn("t_statistic", t).withColumn("degrees_of_freedom", df)
    p = F.least(F.lit(1.0), student_t_two_sided("t_statistic", "degrees_of_freedom") * p_factor)
    out = out.withColumn("p_value", F.when(F.col("t_statistic").isNotNull() & F.col("degrees_of_freedom").isNotNull(), p))
    return out.withColumn("is_significant", F.col("p_value") <= alpha)


def welch_from_moments(out: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The test where n_, mean_ and var_ of control and variant are there already, one row per test."""
    change = 100 * safe_ratio(F.col("mean_variant") - F.col("mean_control"), F.col("mean_control"))
    return _welch(out.withColumn("delta_percent", change), alpha)


def two_sample(df: DataFrame, by: Sequence[str], value: str, variant: str, control: str, treatment: str, alpha: float = 0.05, p_factor: int | Column = 1) -> DataFrame:
    """Welch test of ``value`` between two variants per group, null values left out."""
    side = lambda v: F.when(F.col(variant) == v, F.col(value))
    stats = []
    for name, v in (("control", control), ("variant", treatment)):
        x = side(v)
        stats += [F.count(x).alias(f"n_{name}"), F.avg(x).alias(f"mean_{name}"), F.var_samp(x).alias(f"var_{name}")]
    out = df.where(F.col(variant).isin(control, treatment)).groupBy(*by).agg(*stats)
    change = 100 * safe_ratio(F.col("mean_variant") - F.col("mean_control"), F.col("mean_control"))
    return _welch(out.withColumn("delta_percent", change), alpha, p_factor)


def ab_test_by_group(
    df: DataFrame, by: Sequence[str], day: str, variant: str, control: str, treatment: str,
    numerator: str, denominator: str | None = None, alpha: float = 0.05,
) -> DataFrame:
    """Welch test on daily values per group: the metric is summed per day, divided by
    the denominator's daily sum if there is one, and the daily values are compared.
    The means are means of daily values."""
    sums = [F.sum(numerator).alias("_num")] + ([F.sum(denominator).alias("_den")] if denominator else [])
    daily = df.groupBy(*by, day, variant).agg(*sums)
    value = safe_ratio("_num", "_den") if denominator else F.col("_num").cast("double")
    return two_sample(daily.withColumn("_value", value), by, "_value", variant, control, treatment, alpha)


def ab_test_metrics(
    df: DataFrame, by: Sequence[str], metrics: Sequence[str], variant: str, control: str, treatments: Sequence[str],
    alpha: float = 0.05, bonferroni: bool = True, compare_all: bool = False,
) -> DataFrame:
    """The same test for several metrics and several treatments against one control, on
    the rows as they are. With ``compare_all`` the treatments are also compared with each
    other, and ``baseline`` names what stands in the control's place. Bonferroni
    multiplies p by the number of tests per group."""
    arms = [control, *treatments]
    duels = [(a, b) for i, a in enumerate(arms) for b in arms[i + 1:]] if compare_all else [(control, t) for t in treatments]
    factor = len(metrics) * len(duels) if bonferroni else 1
    base = df.select(*by, variant, *[F.col(m).cast("double").alias(m) for m in metrics])
    moments = []
    for m in metrics:
        moments += [F.count(m).alias(f"n_{m}"), F.avg(m).alias(f"mean_{m}"), F.var_samp(m).alias(f"var_{m}")]
    per_variant = base.groupBy(*by, variant).agg(*moments)
    rows = per_variant.select(
        *by, variant,
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("n"), F.col(f"mean_{m}").alias("mean"), F.col(f"var_{m}").alias("var"))
            for m in metrics
        ])),
    )
    # One row per group, metric and variant by now; treatments are laid out beside control.
    pick = lambda v, c: F.max(F.when(F.col(variant) == v, F.col(c)))
    stats = ("n", "mean", "var")
    sides = [
        F.struct(
            F.lit(a).alias("baseline"),
            F.lit(b).alias("treatment"),
            *[pick(a, c).alias(f"{c}_control") for c in stats],
            *[pick(b, c).alias(f"{c}_variant") for c in stats],
        )
        for a, b in duels
    ]
    wide = rows.groupBy(*by, "metric").agg(F.array(*sides).alias("_sides"))
    out = wide.select(*by, "metric", F.inline("_sides")).where("n_control is not null or n_variant is not null")
    out = out.fillna(0, ["n_control", "n_variant"])
    change = 100 * safe_ratio(F.col("mean_variant") - F.col("mean_control"), F.col("mean_control"))
    return _welch(out.withColumn("delta_percent", change), alpha, factor)


def proportions_ztest(df: DataFrame, by: Sequence[str], successes: str, trials: str, variant: str, control: str, treatment: str) -> DataFrame:
    """Pooled two-sided z test of conversion rates."""
    side = lambda v, c: F.sum(F.when(F.col(variant) == v, F.col(c)))
    out = df.groupBy(*by).agg(
        side(control, successes).alias("successes_control"), side(control, trials).alias("trials_control"),
        side(treatment, successes).alias("successes_variant"), side(treatment, trials).alias("trials_variant"),
    )
    rc, rv = safe_ratio("successes_control", "trials_control"), safe_ratio("successes_variant", "trials_variant")
    pooled = safe_ratio(F.col("successes_control") + F.col("successes_variant"), F.col("trials_control") + F.col("trials_variant"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("trials_control") + 1 / F.col("trials_variant")))
    out = out.withColumn("rate_control", rc).withColumn("rate_variant", rv)
    out = out.withColumn("difference", F.col("rate_variant") - F.col("rate_control"))
    out = out.withColumn("lift_percent", 100 * safe_ratio("difference", "rate_control"))
    out = out.withColumn("z_statistic", safe_ratio("difference", spread))
    return out.withColumn("p_value", normal_two_sided("z_statistic"))


def bernoulli_ttest(df: DataFrame, by: Sequence[str], successes: str, trials: str, variant: str, control: str, treatment: str, alpha: float = 0.05) -> DataFrame:
    """Welch test of 0/1 outcomes from their counts alone: the variance of n such values
    with mean p is p(1-p)n/(n-1)."""
    side = lambda v, c: F.sum(F.when(F.col(variant) == v, F.col(c)))
    out = df.groupBy(*by).agg(
        side(control, trials).alias("n_control"), safe_ratio(side(control, successes), side(control, trials)).alias("mean_control"),
        side(treatment, trials).alias("n_variant"), safe_ratio(side(treatment, successes), side(treatment, trials)).alias("mean_variant"),
    )
    for s in ("control", "variant"):
        p, n = F.col(f"mean_{s}"), F.col(f"n_{s}")
        out = out.withColumn(f"var_{s}", p * (1 - p) * safe_ratio(n, n - 1))
    return _welch(out, alpha)


def _ratio_moments(df: DataFrame, by: Sequence[str], numerator: str, denominator: str) -> DataFrame:
    """Mean ratio of sums per group and its delta-method variance for one unit."""
    n, d = F.col(numerator).cast("double"), F.col(denominator).cast("double")
    m = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg(n).alias("_mn"), F.avg(d).alias("_md"),
        F.var_samp(n).alias("_vn"), F.var_samp(d).alias("_vd"), F.covar_samp(n, d).alias("_c"),
    )
    r = safe_ratio("_mn", "_md")
    var = safe_ratio(F.col("_vn") - 2 * r * F.col("_c") + r * r * F.col("_vd"), F.col("_md") * F.col("_md"))
    return m.select(*by, "n_units", r.alias("ratio"), F.greatest(var, F.lit(0.0)).alias("unit_variance"))


def mde_ratio_metric(df: DataFrame, by: Sequence[str], numerator: str, denominator: str, alpha: float = 0.05, power: float = 0.8, comparisons: int = 1, treatment_share: float = 0.5) -> DataFrame:
    """Smallest effect on a ratio of sums that a test of all these units could find:
    normal approximation with delta-method variance. Rows are one per unit; alpha is
    divided by the number of comparisons."""
    factor = normal_quantile(1 - alpha / comparisons / 2) + normal_quantile(power)
    m = _ratio_moments(df, by, numerator, denominator)
    sizes = 1 / (F.col("n_units") * treatment_share) + 1 / (F.col("n_units") * (1 - treatment_share))
    absolute = F.lit(factor) * F.sqrt(F.col("unit_variance") * sizes)
    return m.withColumn("absolute_mde", absolute).withColumn("relative_mde", safe_ratio("absolute_mde", F.abs(F.col("ratio"))))


def ratio_difference(df: DataFrame, numerator: str, denominator: str, variant: str, control: str, treatment: str, confidence: float = 0.95) -> DataFrame:
    """Difference of a ratio of sums between two variants with its interval (delta method)."""
    m = _ratio_moments(df.where(F.col(variant).isin(control, treatment)), [variant], numerator, denominator)
    side = lambda v, c: F.max(F.when(F.col(variant) == v, F.col(c)))
    out = m.agg(*[side(v, c).alias(f"{c}_{n}") for n, v in (("control", control), ("variant", treatment)) for c in ("n_units", "ratio", "unit_variance")])
    error = F.sqrt(safe_ratio("unit_variance_control", "n_units_control") + safe_ratio("unit_variance_variant", "n_units_variant"))
    half = F.lit(normal_quantile(0.5 + confidence / 2)) * F.col("standard_error")
    out = out.withColumn("difference", F.col("ratio_variant") - F.col("ratio_control")).withColumn("standard_error", error)
    return out.withColumn("lower", F.col("difference") - half).withColumn("upper", F.col("difference") + half)


def power_curve(df: DataFrame, value: str, effects: Sequence[float], shares: Sequence[float], alpha: float = 0.1) -> DataFrame:
    """Power of a two-sided test for each relative effect and treatment share, from the
    moments of one pass over the units."""
    m = df.agg(F.count(value).alias("n_units"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    grid = m.withColumn("relative_effect", F.explode(F.array(*[F.lit(float(e)) for e in effects])))
    grid = grid.withColumn("treatment_share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    n, s = F.col("n_units"), F.col("treatment_share")
    error = F.sqrt(F.col("variance") * (1 / (n * s) + 1 / (n * (1 - s))))
    shift = safe_ratio(F.abs(F.col("mean") * F.col("relative_effect")), error)
    limit = normal_quantile(1 - alpha / 2)
    grid = grid.withColumn("_shift", shift)
    power = normal_cdf(F.col("_shift") - limit) + normal_cdf(-F.col("_shift") - limit)
    return grid.withColumn("standardised_effect", F.col("_shift")).withColumn("power", power).drop("_shift")


def exact_power_curve(df: DataFrame, by: Sequence[str], value: str, effects: Sequence[float], shares: Sequence[float], alpha: float = 0.1, power: float = 0.8) -> DataFrame:
    """``power_curve`` per group with Student's t in place of the normal: ``exact_power`` beside the
    normal ``power``, and ``detectable_effect``, the absolute effect that a test of these units finds with
    the power asked for. Both need n - 2 > 0 degrees of freedom."""
    m = df.groupBy(*by).agg(F.count(value).alias("n_units"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    # The search for the detectable effect runs once per group, before the grid.
    freedom = F.when(F.col("n_units") > 2, (F.col("n_units") - 2).cast("double"))
    m = m.withColumn("degrees_of_freedom", freedom).withColumn("_shift", detectable_shift(F.lit(float(power)), "degrees_of_freedom", F.lit(float(alpha))))
    grid = m.withColumn("treatment_share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    n, s = F.col("n_units"), F.col("treatment_share")
    grid = grid.withColumn("_error", F.sqrt(F.col("variance") * (1 / (n * s) + 1 / (n * (1 - s))))).withColumn("detectable_effect", F.col("_shift") * F.col("_error"))
    grid = grid.withColumn("relative_effect", F.explode(F.array(*[F.lit(float(e)) for e in effects])))
    grid = grid.withColumn("standardised_effect", safe_ratio(F.abs(F.col("mean") * F.col("relative_effect")), "_error"))
    limit = normal_quantile(1 - alpha / 2)
    normal = normal_cdf(F.col("standardised_effect") - limit) + normal_cdf(-F.col("standardised_effect") - limit)
    grid = grid.withColumn("power", normal).withColumn("exact_power", exact_power("standardised_effect", "degrees_of_freedom", F.lit(float(alpha))))
    return grid.drop("_shift", "_error")


def sample_ratio_check(counts: DataFrame, by: Sequence[str], variant: str, n: str, expected: dict[str, float]) -> DataFrame:
    """Chi-square test of the variants' sizes against the planned shares."""
    sizes = counts.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(variant) == v, F.col(n))), F.lit(0)).alias(f"n_{v}") for v in expected])
    total = sum((F.col(f"n_{v}") for v in list(expected)[1:]), F.col(f"n_{list(expected)[0]}"))
    chi = F.lit(0.0)
    for v, share in expected.items():
        chi = chi + safe_ratio(F.pow(F.col(f"n_{v}") - total * share, 2), total * share)
    out = sizes.withColumn("chi_square", chi)
    return out.withColumn("p_value", chi_square_upper("chi_square", F.lit(float(len(expected) - 1))))


def point_estimates(df: DataFrame, variant: str, customer: str, metrics: Sequence[str]) -> DataFrame:
    """Metric total over unique known customers, per variant."""
    per_customer = df.where(F.col(customer).isNotNull()).groupBy(variant, customer).agg(*[F.sum(m).alias(m) for m in metrics])
    n = F.count(F.lit(1))
    return per_customer.groupBy(variant).agg(n.alias("n_customers"), *[safe_ratio(F.sum(m), n).alias(f"{m}_per_customer") for m in metrics])


def remove_outlier_units(df: DataFrame, unit: str, limits: dict[str, float]) -> DataFrame:
    """Drop every row of a unit that exceeds any limit in any row."""
    heavy = F.lit(False)
    for c, limit in limits.items():
        heavy = heavy | (F.col(c) > limit)
    return df.join(df.where(heavy).select(unit).distinct(), unit, "left_anti")


def relative_difference(df: DataFrame, by: Sequence[str], value: str, treated: str) -> DataFrame:
    """Mean of treated and untreated rows per group, and their relative difference in percent."""
    t, c = F.avg(F.when(F.col(treated), F.col(value))), F.avg(F.when(~F.col(treated), F.col(value)))
    out = df.groupBy(*by).agg(t.alias("mean_treated"), c.alias("mean_untreated"))
    return out.withColumn("relative_diff_percent", 100 * safe_ratio(F.col("mean_treated") - F.col("mean_untreated"), F.col("mean_untreated")))


def false_positive_rate(tests: DataFrame, alpha: float) -> DataFrame:
    """Share of A/A tests with p below alpha."""
    return tests.agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col("p_value") < alpha).alias("n_significant")
    ).withColumn("false_positive_rate", safe_ratio("n_significant", "n_tests"))
