"""Experiment inference, assignment and statistics.

DuckDB has no normal or t distribution either, so the SQL texts integrate the density
by Simpson's rule over 2000 steps.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cohorta.operators import inference as I
from cohorta.operators import ranks as R
from cohorta.operators import splits as L
from cohorta.plans.base import lines, orders, query, r, scan_table
from cohorta.plans.basket import AB_CTE, OBSERVATIONS_CTE, UNITS_CTE, ab_customers, units, weekly_observations

_WEIGHT = "(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end)"


def t_p(t, df):
    return (
        f"(1 - 2 * abs({t}) / 6000 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * "
        f"list_sum(list_transform(range(0, 2001), lambda i: {_WEIGHT} * power(1 + power(abs({t}) * i / 2000, 2) / {df}, -({df} + 1) / 2))))"
    )


def half_normal(z):
    """Normal probability between 0 and z."""
    return f"({z} / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: {_WEIGHT} * exp(-power({z} * i / 2000, 2) / 2))))"


def welch(source, by, value, control="'control'", treatment="'variant'"):
    """CTEs s and w: Welch statistics of ``value`` by variant within ``by``."""
    return f"""
s as (select {by} count({value}) filter (where variant = {control}) as n_control, avg({value}) filter (where variant = {control}) as mean_control,
 var_samp({value}) filter (where variant = {control}) as vc, count({value}) filter (where variant = {treatment}) as n_variant,
 avg({value}) filter (where variant = {treatment}) as mean_variant, var_samp({value}) filter (where variant = {treatment}) as vv from {source} group by all),
w as (select *, 100 * (mean_variant - mean_control) / mean_control as delta, (mean_control - mean_variant) / sqrt(vc / n_control + vv / n_variant) as t,
 power(vc / n_control + vv / n_variant, 2) / (power(vc / n_control, 2) / (n_control - 1) + power(vv / n_variant, 2) / (n_variant - 1)) as df from s)"""


_OUT = f"""n_control, n_variant, round(mean_control, 6) as mean_control, round(mean_variant, 6) as mean_variant, round(delta, 6) as delta_percent,
 round(t, 6) as t_statistic, round(df, 4) as degrees_of_freedom, round({t_p('t', 'df')}, 6) as p_value"""


def tidy(df, *keys):
    return df.select(
        *keys, "n_control", "n_variant", r("mean_control").alias("mean_control"), r("mean_variant").alias("mean_variant"), r("delta_percent").alias("delta_percent"),
        r("t_statistic").alias("t_statistic"), r("degrees_of_freedom", 4).alias("degrees_of_freedom"), r("p_value").alias("p_value"),
    )


# -- tests --------------------------------------------------------------------

_AB_ORDERS = f"""with {AB_CTE}, x as (select o_orderpriority, date_trunc('month', o_orderdate) as day, variant, sum(o_totalprice) as num, count(*) as den
 from orders join ab on o_custkey = c_custkey group by all), """


def ab_orders(spark, folder):
    o = orders(spark, folder).join(ab_customers(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
    return o.withColumn("month", F.date_trunc("month", "o_orderdate")).withColumn("one", F.lit(1))


@query("ab_test_by_group", _AB_ORDERS + "y as (select *, num / den as v from x), " + welch("y", "o_orderpriority,", "v")
       + f" select o_orderpriority, {_OUT}, {t_p('t', 'df')} <= 0.05 as is_significant from w")
def _(spark, folder):
    out = I.ab_test_by_group(ab_orders(spark, folder), ["o_orderpriority"], "month", "variant", "control", "variant", "o_totalprice", "one", 0.05)
    return tidy(out, "o_orderpriority", "is_significant")


@query("ab_test_single_metric", _AB_ORDERS + welch("x", "o_orderpriority,", "den") + f" select o_orderpriority, {_OUT} from w")
def _(spark, folder):
    out = I.ab_test_by_group(ab_orders(spark, folder), ["o_orderpriority"], "month", "variant", "control", "variant", "one")
    return tidy(out, "o_orderpriority")


METRICS = ["n_delivered", "n_returned", "n_urgent"]
_LONG = f"with {UNITS_CTE}, x as (unpivot (select c_custkey, c_nationkey, variant, " + ", ".join(f"cast({m} as double) as {m}" for m in METRICS) + f" from units) on {', '.join(METRICS)} into name metric value v), "


@query("welch_by_city_and_metric", _LONG + welch("x", "c_nationkey, metric,", "v") + f" select c_nationkey, metric, {_OUT} from w")
def _(spark, folder):
    out = I.ab_test_metrics(units(spark, folder), ["c_nationkey"], METRICS, "variant", "control", ["variant"], bonferroni=False)
    return tidy(out, "c_nationkey", "metric")


_THREE = "case when cast('0x' || substr(md5('three' || c_custkey), 1, 8) as bigint) % 1000 < 334 then 'control' when cast('0x' || substr(md5('three' || c_custkey), 1, 8) as bigint) % 1000 < 667 then 'variant 1' else 'variant 2' end"


@query("multi_metric_experiment", f"with {UNITS_CTE}, x0 as (unpivot (select c_custkey, {_THREE} as v3, " + ", ".join(f"cast({m} as double) as {m}" for m in METRICS)
       + f" from units) on {', '.join(METRICS)} into name metric value v), x as (select metric, baseline, treatment, v, case when v3 = baseline then 'control' else 'variant' end as variant"
       + " from x0, (values ('control', 'variant 1'), ('control', 'variant 2'), ('variant 1', 'variant 2')) t(baseline, treatment) where v3 in (baseline, treatment)), "
       + welch("x", "metric, baseline, treatment,", "v")
       + f" select metric, baseline, treatment, {_OUT.replace('round(' + t_p('t', 'df'), 'round(least(1, 9 * ' + t_p('t', 'df') + ')')} from w")
def _(spark, folder):
    u = L.assign_by_hash(units(spark, folder), "c_custkey", "three", [(334, "control"), (667, "variant 1"), (1000, "variant 2")])
    out = I.ab_test_metrics(u, [], METRICS, "variant", "control", ["variant 1", "variant 2"], compare_all=True)
    return tidy(out, "metric", "baseline", "treatment")


_PROP = f"""with {AB_CTE}, s as (select o_orderpriority, count(*) filter (where variant = 'control') as tc, count(*) filter (where variant = 'control' and o_orderstatus = 'F') as sc,
 count(*) filter (where variant = 'variant') as tv, count(*) filter (where variant = 'variant' and o_orderstatus = 'F') as sv from orders join ab on o_custkey = c_custkey group by 1)"""


def _conversions(spark, folder):
    return ab_orders(spark, folder).withColumn("done", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))


@query("proportions_ztest", _PROP + f""",
z as (select *, sc / tc as rc, sv / tv as rv, (sv / tv - sc / tc) / sqrt((sc + sv) / (tc + tv) * (1 - (sc + sv) / (tc + tv)) * (1 / tc + 1 / tv)) as z from s)
select o_orderpriority, tc as trials_control, tv as trials_variant, round(rc, 6) as rate_control, round(rv, 6) as rate_variant, round(100 * (rv - rc) / rc, 6) as lift_percent,
 round(z, 6) as z_statistic, round(1 - 2 * {half_normal('abs(z)')}, 6) as p_value from z""")
def _(spark, folder):
    out = I.proportions_ztest(_conversions(spark, folder), ["o_orderpriority"], "done", "one", "variant", "control", "variant")
    return out.select("o_orderpriority", "trials_control", "trials_variant", *[r(c).alias(c) for c in ("rate_control", "rate_variant", "lift_percent", "z_statistic", "p_value")])


@query("bernoulli_ttest", f"with {AB_CTE}, x as (select o_orderpriority, variant, case when o_orderstatus = 'F' then 1 else 0 end as v from orders join ab on o_custkey = c_custkey), "
       + welch("x", "o_orderpriority,", "v") + f""" select o_orderpriority, n_control, n_variant, round(mean_control, 6) as mean_control, round(mean_variant, 6) as mean_variant,
 round(t, 6) as t_statistic, round(df, 4) as degrees_of_freedom, round({t_p('t', 'df')}, 6) as p_value from w""")
def _(spark, folder):
    out = I.bernoulli_ttest(_conversions(spark, folder), ["o_orderpriority"], "done", "one", "variant", "control", "variant")
    return tidy(out.withColumn("delta_percent", F.lit(0.0)), "o_orderpriority").drop("delta_percent")


@query("point_estimates", f"""
with {UNITS_CTE} select variant, count(distinct c_custkey) as n_customers, round(sum(gmv) / count(distinct c_custkey), 4) as gmv_per_customer,
 round(sum(n_returned) / count(distinct c_custkey), 6) as n_returned_per_customer from units group by 1""")
def _(spark, folder):
    out = I.point_estimates(units(spark, folder), "variant", "c_custkey", ["gmv", "n_returned"])
    return out.select("variant", "n_customers", r("gmv_per_customer", 4).alias("gmv_per_customer"), r("n_returned_per_customer").alias("n_returned_per_customer"))


_MOMENTS = """count(*) as n, avg(n_returned) as mn, avg(n_delivered) as md, var_samp(n_returned) as vn, var_samp(n_delivered) as vd, covar_samp(n_returned, n_delivered) as c"""
_UNITVAR = "(vn - 2 * mn / md * c + power(mn / md, 2) * vd) / power(md, 2)"


@query("ratio_difference_interval", f"""
with {UNITS_CTE}, m as (select variant, {_MOMENTS} from units group by 1), k as (select variant, n, mn / md as ratio, {_UNITVAR} as uv from m),
d as (select b.ratio - a.ratio as d, sqrt(a.uv / a.n + b.uv / b.n) as se, a.ratio as rc, b.ratio as rv from k a, k b where a.variant = 'control' and b.variant = 'variant')
select round(rc, 6) as ratio_control, round(rv, 6) as ratio_variant, round(d, 6) as difference, round(se, 8) as standard_error,
 round(d - 1.959963984540054 * se, 6) as lower, round(d + 1.959963984540054 * se, 6) as upper from d""")
def _(spark, folder):
    out = I.ratio_difference(units(spark, folder), "n_returned", "n_delivered", "variant", "control", "variant")
    return out.select(*[r(c, 8 if c == "standard_error" else 6).alias(c) for c in ("ratio_control", "ratio_variant", "difference", "standard_error", "lower", "upper")])


@query("mde_ratio_metric", f"""
with {UNITS_CTE}, m as (select c_mktsegment, {_MOMENTS} from units group by 1),
k as (select c_mktsegment, n as n_units, mn / md as ratio, (1.959963984540054 + 0.8416212335729143) * sqrt({_UNITVAR} * (1 / (n * 0.5) + 1 / (n * 0.5))) as a from m)
select c_mktsegment, n_units, round(ratio, 6) as ratio, round(a, 6) as absolute_mde, round(a / abs(ratio), 6) as relative_mde from k""")
def _(spark, folder):
    out = I.mde_ratio_metric(units(spark, folder), ["c_mktsegment"], "n_returned", "n_delivered")
    return out.select("c_mktsegment", "n_units", r("ratio").alias("ratio"), r("absolute_mde").alias("absolute_mde"), r("relative_mde").alias("relative_mde"))


@query("mde_by_week", f"""
with {OBSERVATIONS_CTE}, m as (select week, {_MOMENTS.replace('n_delivered', 'den').replace('n_returned', 'num')} from (select week, n_delivered as num, n_orders as den from observed where week is not null) group by 1),
k as (select week, n as n_units, mn / md as ratio, (2.241402727604947 + 0.8416212335729143) * sqrt(greatest({_UNITVAR}, 0) * (1 / (n * 0.5) + 1 / (n * 0.5))) as a from m)
select week, n_units, round(ratio, 6) as ratio, round(a, 6) as absolute_mde from k""")
def _(spark, folder):
    """For active customers only: exposed ones without observations have no week."""
    # Running totals per customer and week, as the weekly detectable effect needs them.
    out = I.mde_ratio_metric(weekly_observations(spark, folder).where("week is not null"), ["week"], "n_delivered", "n_orders", comparisons=2)
    return out.select("week", "n_units", r("ratio").alias("ratio"), r("absolute_mde").alias("absolute_mde"))


EFFECTS = [round(0.02 * i, 4) for i in range(20)]
SHARES = [0.1, 0.2, 0.3, 0.4, 0.5]


@query("power_curve", f"""
with {UNITS_CTE}, m as (select count(*) as n, avg(n_delivered) as mean, var_samp(n_delivered) as v from units),
g as (select *, abs(mean * effect) / sqrt(v * (1 / (n * s) + 1 / (n * (1 - s)))) as shift from m, (select unnest({EFFECTS}::double[]) as effect), (select unnest({SHARES}::double[]) as s))
select effect as relative_effect, s as treatment_share, round(shift, 6) as standardised_effect,
 round(0.5 + {half_normal('(shift - 1.6448536269514715)')} + 0.5 - {half_normal('(shift + 1.6448536269514715)')}, 6) as power from g""")
def _(spark, folder):
    out = I.power_curve(units(spark, folder), "n_delivered", EFFECTS, SHARES, 0.1)
    return out.select("relative_effect", "treatment_share", r("standardised_effect").alias("standardised_effect"), r("power").alias("power"))


# -- assignment ---------------------------------------------------------------

@query("assign_by_hash", f"with {AB_CTE} select c_custkey, variant from ab")
def _(spark, folder):
    return ab_customers(spark, folder).select("c_custkey", "variant")


_B = lambda s: f"cast('0x' || substr(md5('{s}' || c_custkey), 1, 8) as bigint) % 1000"


@query("assign_random_nested", f"""
select case when {_B('hold')} < 100 then 'hold-out' when {_B('exp')} < 500 then 'not in test' when {_B('arm')} < 500 then 'control' else 'variant' end as "group", count(*) as n
from customer group by 1""")
def _(spark, folder):
    c = scan_table(spark, folder, "customer", ["c_custkey"])
    out = L.assign_nested(c, "c_custkey", ["hold", "exp", "arm"], [0.1, 0.5, 0.5], [("hold-out", ""), ("not in test", ""), ("control", "variant")])
    return out.groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query("remove_outlier_units", """
with w as (select o_custkey, date_trunc('month', o_orderdate) as m, count(*) as n, sum(o_totalprice) as gmv from orders group by all)
select o_custkey, count(*) as n_months, cast(sum(n) as bigint) as n_orders from w
where o_custkey not in (select o_custkey from w where n > 2 or gmv > 900000) group by 1""")
def _(spark, folder):
    o = orders(spark, folder).groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("gmv"))
    out = I.remove_outlier_units(o, "o_custkey", {"n": 2, "gmv": 900000})
    return out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_months"), F.sum("n").alias("n_orders"))


# -- splits and counterfactuals -----------------------------------------------

CUT = date(1999, 7, 1)
_MONTHS = """months as (select l_suppkey, cast(date_trunc('month', l_shipdate) as date) as day, cast(count(*) as double) as n_lines, sum(l_quantity) as quantity from lineitem group by all)"""


def store_months(spark, folder):
    l = lines(spark, folder, "l_suppkey", "l_shipdate", "l_quantity")
    return l.groupBy("l_suppkey", F.to_date(F.date_trunc("month", "l_shipdate")).alias("day")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))


N_SPLITS = 100


@query("split_search", f"""
with {_MONTHS},
long as (unpivot months on n_lines, quantity into name metric value v),
p as (select split, metric, day, sum(case when b < 52429 then v end) as treat, sum(case when b >= 52429 then v end) as control from
 (select long.*, split, b from long join (select l_suppkey, split, cast('0x' || substr(md5('split' || (split // 8) || '-' || l_suppkey), 4 * (split % 8) + 1, 4) as bigint) as b
  from (select distinct l_suppkey from long), (select unnest(range({N_SPLITS})) as split)) using (l_suppkey)) group by all),
pre as (select * from p where day < date '1999-07-01' and treat is not null and control is not null),
f as (select split, metric, regr_slope(treat, control) as a, regr_intercept(treat, control) as b from pre group by all),
e as (select split, metric, abs(treat - b - a * control) as err, abs(treat - lag(treat) over (partition by split, metric order by day)) as step from pre join f using (split, metric)),
m as (select split, metric, avg(err) / avg(step) as mase from e group by all),
k as (select *, dense_rank() over (partition by metric order by round(mase, 9)) as rk from m),
t as (select split, cast(sum(rk) as bigint) as total_rank, round(max(case when metric = 'n_lines' then mase end), 6) as mase_n_lines, round(max(case when metric = 'quantity' then mase end), 6) as mase_quantity from k group by 1)
select *, row_number() over (order by total_rank, split) = 1 as is_best from t""")
def _(spark, folder):
    out = L.split_search(store_months(spark, folder), "l_suppkey", "day", ["n_lines", "quantity"], N_SPLITS, 0.8, F.col("day") < F.lit(CUT))
    return out.withColumn("mase_n_lines", r("mase_n_lines")).withColumn("mase_quantity", r("mase_quantity"))


_SERIES = f"""with {_MONTHS}, p as (select day, sum(case when b < 800 then n_lines end) as treat, sum(case when b >= 800 then n_lines end) as control from
 (select *, cast('0x' || substr(md5('stores' || l_suppkey), 1, 8) as bigint) % 1000 as b from months) group by 1 having treat is not null and control is not null),
f as (select regr_slope(treat, control) as a, regr_intercept(treat, control) as b from p where day < date '1999-07-01'),
q as (select *, b + a * control as predicted from p, f)"""


def _series(spark, folder):
    m = L.assign_by_hash(store_months(spark, folder), "l_suppkey", "stores", [(800, "Treat"), (1000, "Control")])
    return L.daily_series(m, [], "day", "variant", "n_lines", "Treat", "Control")


@query("counterfactual_effect", _SERIES + """
select day, treat, control, round(predicted, 4) as predicted, round(treat - predicted, 4) as effect, round(sum(treat - predicted) over w, 4) as cumulative_effect,
 round(sum(treat - predicted) over w / sum(predicted) over w, 6) as relative_effect,
 round(sum(treat - predicted) over w - 1.959963984540054 * se, 4) as cumulative_lower, round(sum(treat - predicted) over w + 1.959963984540054 * se, 4) as cumulative_upper,
 round(1 - 2 * (""" + half_normal("abs(sum(treat - predicted) over w / se)") + """), 6) as p_value
from (select *, sqrt(sse / (n - 2) * (count(*) over w + power(count(*) over w, 2) / n + power(sum(control - mx) over w, 2) / sxx)) as se
      from q, (select count(*) as n, regr_avgx(treat, control) as mx, regr_sxx(treat, control) as sxx, sum(power(treat - predicted, 2)) as sse from q where day < date '1999-07-01')
      where day >= date '1999-07-01' window w as (order by day)) window w as (order by day)""")
def _(spark, folder):
    day = F.col("day")
    out = L.counterfactual_effect(_series(spark, folder), [], "day", day < F.lit(CUT), day >= F.lit(CUT))
    return out.select("day", "treat", "control", r("predicted", 4).alias("predicted"), r("effect", 4).alias("effect"), r("cumulative_effect", 4).alias("cumulative_effect"), r("relative_effect").alias("relative_effect"), r("cumulative_lower", 4).alias("cumulative_lower"), r("cumulative_upper", 4).alias("cumulative_upper"), r("p_value").alias("p_value"))


@query("mase", _SERIES + """,
e as (select case when day < date '1999-07-01' then 'pre' else 'post' end as period, abs(treat - predicted) as err,
 abs(treat - lag(treat) over (partition by day < date '1999-07-01' order by day)) as step from q)
select period, round(avg(err) / avg(step), 6) as mase from e group by 1""")
def _(spark, folder):
    day = F.col("day")
    fitted = L.pre_period_fit(_series(spark, folder), [], day < F.lit(CUT)).withColumn("period", F.when(day < F.lit(CUT), "pre").otherwise("post"))
    return L.mase(fitted, [], "day", "period").withColumn("mase", r("mase"))


# -- description --------------------------------------------------------------

@query("correlation_pearson", """
select 'l_quantity' as x, 'l_extendedprice' as y, round(corr(l_quantity, l_extendedprice), 6) as pearson from lineitem union all
select 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) from lineitem union all
select 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) from lineitem""")
def _(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    return L.correlation_matrix(lines(spark, folder, *columns), columns).withColumn("pearson", r("pearson"))


@query("correlation_spearman", f"""
with {UNITS_CTE}, k as (select rank() over (order by n_delivered) + (count(*) over (partition by n_delivered) - 1) / 2 as a,
 rank() over (order by n_returned) + (count(*) over (partition by n_returned) - 1) / 2 as b from units) select round(corr(a, b), 6) as spearman from k""")
def _(spark, folder):
    return R.average_rank_correlation(units(spark, folder), "n_delivered", "n_returned").withColumn("spearman", r("spearman"))


@query("linear_regression", """
select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept,
 round(corr(l_quantity, l_extendedprice), 6) as pearson, round(regr_intercept(l_extendedprice, l_quantity) + 25 * regr_slope(l_extendedprice, l_quantity), 4) as predicted_at_25 from lineitem group by 1""")
def _(spark, folder):
    out = L.linear_regression(lines(spark, folder, "l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    out = out.withColumn("predicted_at_25", r(F.col("intercept") + 25 * F.col("slope"), 4))
    return out.withColumn("slope", r("slope", 4)).withColumn("intercept", r("intercept", 4)).withColumn("pearson", r("pearson"))


@query("summary_statistics", """
select o_orderstatus, count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as lowest,
 round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.75), 4) as p75, max(o_totalprice) as highest from orders group by 1""")
def _(spark, folder):
    o = scan_table(spark, folder, "orders", ["o_orderstatus", "o_totalprice"])
    p = R.percentiles(o, ["o_orderstatus"], "o_totalprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    m = o.groupBy("o_orderstatus").agg(
        F.count("o_totalprice").alias("n"), r(F.avg("o_totalprice"), 4).alias("mean"), r(F.stddev_samp("o_totalprice"), 4).alias("std"),
        F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"),
    )
    return m.join(p.select("o_orderstatus", *[r(c, 4).alias(c) for c in ("p25", "p50", "p75")]), "o_orderstatus")
