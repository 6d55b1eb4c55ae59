"""Models behind experiments: regression, counterfactuals, clustered and combined effects, exact power.

The SQL texts come to the same numbers another way: closed forms, Newton's steps and
filters as recursive queries, influence values row by row, integrals by Simpson's rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohorta.functions.columns import bucket_variant, hash_bucket
from cohorta.operators import clusters as K
from cohorta.operators import effects as E
from cohorta.operators import inference as I
from cohorta.operators import regression as G
from cohorta.operators import simulation as S
from cohorta.operators import splits as L
from cohorta.plans.base import lines, orders, query, r
from cohorta.plans.basket import UNITS_CTE, units
from cohorta.plans.experiments import _MONTHS, CUT, half_normal, store_months, t_p


def rounded(df, *keys, digits=6):
    return df.select(*keys, *[r(c, digits).alias(c) for c in df.columns if c not in keys])


# -- Poisson regression -------------------------------------------------------

_COEFFICIENT = f"""select term, round(b, 6) as coefficient, round(se, 6) as standard_error, round(b / se, 4) as z_statistic,
 round(abs(1 - 2 * {half_normal('least(abs(b / se), 12)')}), 6) as p_value, round(b - 1.959963984540054 * se, 6) as lower, round(b + 1.959963984540054 * se, 6) as upper"""


def _coefficients(out):
    columns = [r(c, 4 if c == "z_statistic" else 6).alias(c) for c in ("coefficient", "standard_error", "z_statistic", "p_value", "lower", "upper")]
    return out.select("term", *columns)


@query("poisson_categories", f"""
with {UNITS_CTE}, cell as (select variant, c_mktsegment as seg, avg(n_delivered) as m, sum(n_delivered) as t from units group by all),
x as (select a.seg, a.m as mc, a.t as tc, b.m as mv, b.t as tv from cell a join cell b using (seg) where a.variant = 'control' and b.variant = 'variant'),
z as (select * from x order by seg limit 1), y as (select x.*, z.mc as mc0, z.tc as tc0, z.mv as mv0, z.tv as tv0 from x, z where x.seg <> z.seg),
c as (select 'intercept' as term, ln(mc) as b, sqrt(1 / tc) as se from z union all
 select 'variant[variant]', ln(mv / mc), sqrt(1 / tv + 1 / tc) from z union all
 select 'c_mktsegment[' || seg || ']', ln(mc / mc0), sqrt(1 / tc + 1 / tc0) from y union all
 select 'variant[variant]:c_mktsegment[' || seg || ']', ln(mv / mc) - ln(mv0 / mc0), sqrt(1 / tc + 1 / tc0 + 1 / tv + 1 / tv0) from y)
{_COEFFICIENT} from c""")
def _(spark, folder):
    # Every cell has its own mean, so the closed form is known.
    u = units(spark, folder)
    variant, segment = G.category(u, "variant", "control"), G.category(u, "c_mktsegment")
    return _coefficients(G.poisson_regression(u, "n_delivered", variant + segment + G.interaction(variant, segment), collapse=True))


@query("poisson_regression", f"""
with recursive {UNITS_CTE}, d as (select sqrt(n_delivered) as x, sum(n_returned)::double as y, count(*)::double as n from units group by 1),
f as (select 0 as i, ln(sum(y) / sum(n)) as a, 0.0::double as b, 0.0::double as h00, 0.0::double as h01, 0.0::double as h11 from d union all
 select i + 1, a + (g0 * k11 - g1 * k01) / (k00 * k11 - k01 * k01), b + (k00 * g1 - k01 * g0) / (k00 * k11 - k01 * k01), k00, k01, k11 from
  (select i, a, b, sum(y - n * exp(a + b * x)) as g0, sum((y - n * exp(a + b * x)) * x) as g1, sum(n * exp(a + b * x)) as k00, sum(n * exp(a + b * x) * x) as k01,
   sum(n * exp(a + b * x) * x * x) as k11 from f, d where i < 30 group by i, a, b)),
l as (select * from f where i = 30),
c as (select 'intercept' as term, a as b, sqrt(h11 / (h00 * h11 - h01 * h01)) as se from l union all select 'past_orders', b, sqrt(h00 / (h00 * h11 - h01 * h01)) from l)
{_COEFFICIENT} from c""")
def _(spark, folder):
    out = G.poisson_regression(units(spark, folder), "n_returned", G.numeric("past_orders", F.sqrt("n_delivered")))
    return _coefficients(out)


# -- counterfactuals ----------------------------------------------------------

_BUCKET = "cast('0x' || substr(md5('stores' || l_suppkey), 1, 8) as bigint) % 1000"


def two_controls(spark, folder):
    m = L.assign_by_hash(store_months(spark, folder), "l_suppkey", "stores", [(800, "Treat"), (1000, "Control")])
    side = lambda v, c: F.sum(F.when(F.col("variant") == v, F.col(c)))
    out = m.groupBy("day").agg(side("Treat", "n_lines").alias("treat"), side("Control", "n_lines").alias("control_lines"), side("Control", "quantity").alias("control_quantity"))
    return out.dropna()


@query("counterfactual_two_controls", f"""
with {_MONTHS}, s as (select day, sum(case when b < 800 then n_lines end) as treat, sum(case when b >= 800 then n_lines end) as x1, sum(case when b >= 800 then quantity end) as x2
 from (select *, {_BUCKET} as b from months) group by 1 having treat is not null and x1 is not null),
m as (select count(*) as n, avg(treat) as my, avg(x1) as m1, avg(x2) as m2, n * var_pop(x1) as s11, n * covar_pop(x1, x2) as s12, n * var_pop(x2) as s22,
 n * covar_pop(x1, treat) as r1, n * covar_pop(x2, treat) as r2, n * var_pop(treat) as yy from s where day < date '1999-07-01'),
k as (select *, s11 * s22 - s12 * s12 as det, (r1 * s22 - r2 * s12) / det as b1, (s11 * r2 - s12 * r1) / det as b2, (yy - b1 * r1 - b2 * r2) / (n - 3) as noise from m),
q as (select day, treat, my + b1 * (x1 - m1) + b2 * (x2 - m2) as predicted, count(*) over w as d, sum(x1 - m1) over w as g1, sum(x2 - m2) over w as g2, n, noise, det, s11, s12, s22
 from s, k where day >= date '1999-07-01' window w as (order by day)),
e as (select *, sqrt(noise * (d + d * d / n + (s22 * g1 * g1 - 2 * s12 * g1 * g2 + s11 * g2 * g2) / det)) as se, sum(treat - predicted) over w as total, sum(predicted) over w as expected
 from q window w as (order by day))
select day, round(predicted, 4) as predicted, round(treat - predicted, 4) as effect, round(total, 4) as cumulative_effect, round(total / expected, 6) as relative_effect,
 round(se, 4) as standard_error, round(total - 1.959963984540054 * se, 4) as cumulative_lower, round(total + 1.959963984540054 * se, 4) as cumulative_upper,
 round(abs(1 - 2 * {half_normal('least(abs(total / se), 12)')}), 6) as p_value from e""")
def _(spark, folder):
    day = F.col("day")
    out = E.counterfactual_with_controls(two_controls(spark, folder), [], "day", "treat", ["control_lines", "control_quantity"], day < F.lit(CUT), day >= F.lit(CUT))
    four = ("predicted", "effect", "cumulative_effect", "standard_error", "cumulative_lower", "cumulative_upper")
    return out.select("day", *[r(c, 4).alias(c) for c in four], r("relative_effect").alias("relative_effect"), r("p_value").alias("p_value"))


LEVEL_RATIOS = [0.0, 0.01, 0.1, 1.0, 10.0]


@query("local_level_effect", f"""
with recursive s as (select l_returnflag as flag, cast(date_trunc('month', l_shipdate) as date) as day, count(*)::double as y, sum(l_quantity) as quantity from lineitem group by all),
pre as (select *, row_number() over (partition by flag order by day) as t from s where day < date '1999-07-01'),
f as (select flag, q, t, y as a, 1.0::double as p, 0.0::double as sq, 0.0::double as lg from pre, (select unnest({LEVEL_RATIOS}::double[]) as q) where t = 1 union all
 select f.flag, q, pre.t, a + (p + q) / (p + q + 1) * (y - a), (p + q) / (p + q + 1), sq + (y - a) * (y - a) / (p + q + 1), lg + ln(p + q + 1) from f join pre on pre.flag = f.flag and pre.t = f.t + 1),
l as (select *, sq / (t - 1) as noise, -0.5 * ((t - 1) * ln(sq / (t - 1)) + lg) as ll from f where (flag, t) in (select flag, max(t) from pre group by 1)),
b as (select * from l qualify row_number() over (partition by flag order by ll desc, q) = 1),
o as (select s.flag, day, y, a, noise, q, p, row_number() over (partition by s.flag order by day) as h from s join b on b.flag = s.flag where day >= date '1999-07-01'),
e as (select *, sqrt(noise * (p + h * q + 1)) as pe, sqrt(noise * (h * h * p + q * h * (h + 1) * (2 * h + 1) / 6 + h)) as se, sum(y - a) over (partition by flag order by day) as total from o)
select flag as l_returnflag, day, q as level_ratio, round(a, 4) as predicted, round(y - a, 4) as effect, round(pe, 4) as prediction_error, round(total, 4) as cumulative_effect,
 round(se, 4) as standard_error, round(total - 1.959963984540054 * se, 4) as cumulative_lower, round(total + 1.959963984540054 * se, 4) as cumulative_upper from e""")
def _(spark, folder):
    l = lines(spark, folder, "l_returnflag", "l_shipdate")
    series = l.groupBy("l_returnflag", F.to_date(F.date_trunc("month", "l_shipdate")).alias("day")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    day = F.col("day")
    out = E.local_level_effect(series, ["l_returnflag"], "day", "y", [], day < F.lit(CUT), day >= F.lit(CUT), LEVEL_RATIOS, refine=False)
    columns = "predicted effect prediction_error cumulative_effect standard_error cumulative_lower cumulative_upper".split()
    return out.select("l_returnflag", "day", "level_ratio", *[r(c, 4).alias(c) for c in columns])


# -- clusters and combinations ------------------------------------------------

_CLUSTER_ROWS = """x as (select o_orderstatus, o_custkey, o_totalprice as price, case when o_orderpriority = '1-URGENT' then 1.0 else 0.0 end as urgent,
 case when cast('0x' || substr(md5('cluster' || o_custkey || '-' || strftime(o_orderdate, '%Y-%m')), 1, 8) as bigint) % 1000 < 500 then 'control' else 'variant' end as variant from orders)"""


def clustered_orders(spark, folder):
    """Orders whose variant changes within a customer, month by month."""
    unit = F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyy-MM"))
    o = orders(spark, folder).withColumn("variant", bucket_variant(hash_bucket(unit, "cluster"), [(500, "control"), (1000, "variant")]))
    return o.select("o_orderstatus", "o_custkey", "variant", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0).alias("urgent"))


@query("clustered_test", f"""
with {_CLUSTER_ROWS}, long as (unpivot (select * from x) on price, urgent into name metric value v),
t as (select o_orderstatus, metric, count(v) filter (where variant = 'control') as nc, count(v) filter (where variant = 'variant') as nv,
 avg(v) filter (where variant = 'control') as mc, avg(v) filter (where variant = 'variant') as mv from long group by all),
i as (select o_orderstatus, metric, o_custkey, sum(case when variant = 'variant' then (v - mv) / nv else -(v - mc) / nc end) as u from long join t using (o_orderstatus, metric) group by all),
s as (select o_orderstatus, metric, count(*) as c, sqrt(sum(u * u) * count(*) / (count(*) - 1)) as se from i group by all)
select o_orderstatus, metric, c as n_clusters, nc as n_control, nv as n_variant, round(mc, 6) as mean_control, round(mv, 6) as mean_variant, round(mv - mc, 6) as difference,
 round(se, 6) as standard_error, round((mv - mc) / se, 6) as t_statistic, round({t_p('((mv - mc) / se)', '(c - 1)')}, 6) as p_value from t join s using (o_orderstatus, metric)""")
def _(spark, folder):
    out = K.clustered_test(clustered_orders(spark, folder), ["o_orderstatus"], ["price", "urgent"], "o_custkey", "variant", "control", "variant")
    columns = ["mean_control", "mean_variant", "difference", "standard_error", "t_statistic", "p_value"]
    return out.select("o_orderstatus", "metric", "n_clusters", "n_control", "n_variant", *[r(c).alias(c) for c in columns])


WEIGHTS = {"price": 0.7, "urgent": -0.2}


@query("composite_effect", f"""
with {_CLUSTER_ROWS}, t as (select o_orderstatus, variant, count(*) as n, avg(price) as mp, avg(urgent) as mu from x group by all),
k as (select a.o_orderstatus, a.n as nc, b.n as nv, a.mp as pc, b.mp as pv, a.mu as uc, b.mu as uv from t a join t b using (o_orderstatus) where a.variant = 'control' and b.variant = 'variant'),
i as (select o_orderstatus, o_custkey, sum(case when variant = 'variant' then 0.7 * (price - pv) / nv / pc - 0.2 * (urgent - uv) / nv / uc
  else -0.7 * (price - pc) / nc * pv / pc / pc + 0.2 * (urgent - uc) / nc * uv / uc / uc end) as u from x join k using (o_orderstatus) group by all),
s as (select o_orderstatus, count(*) as c, sqrt(sum(u * u) * count(*) / (count(*) - 1)) as se from i group by 1),
e as (select *, 0.7 * (pv / pc - 1) - 0.2 * (uv / uc - 1) as composite from k join s using (o_orderstatus))
select o_orderstatus, c as n_clusters, round(pv / pc - 1, 6) as effect_price, round(uv / uc - 1, 6) as effect_urgent, round(composite, 6) as composite, round(se, 6) as standard_error,
 round(composite - 1.6448536269514715 * se, 6) as lower, round(composite + 1.6448536269514715 * se, 6) as upper, round(abs(1 - 2 * {half_normal('least(abs(composite / se), 12)')}), 6) as p_value from e""")
def _(spark, folder):
    out = K.composite_effect(clustered_orders(spark, folder), ["o_orderstatus"], WEIGHTS, "o_custkey", "variant", "control", "variant")
    columns = ["effect_price", "effect_urgent", "composite", "standard_error", "lower", "upper", "p_value"]
    return out.select("o_orderstatus", "n_clusters", *[r(c).alias(c) for c in columns])


# -- repeated splits and power ------------------------------------------------

N_AA = 10_000


@query("false_positive_rate", f"""
with {UNITS_CTE}, d as (select c_custkey, n_delivered as v, h, md5('aa' || h || '-' || c_custkey) as hex from units, (select unnest(range({-(-N_AA // 128)})) as h)),
x as (select h * 128 + bit as split, v, case when ((instr('0123456789abcdef', substr(hex, bit // 4 + 1, 1)) - 1) >> (3 - bit % 4)) & 1 = 1 then 'variant' else 'control' end as variant
 from d, (select unnest(range(128))::int as bit) where h * 128 + bit < {N_AA}),
s as (select split, count(v) filter (where variant = 'control') as n_control, avg(v) filter (where variant = 'control') as mc, var_samp(v) filter (where variant = 'control') as vc,
 count(v) filter (where variant = 'variant') as n_variant, avg(v) filter (where variant = 'variant') as mv, var_samp(v) filter (where variant = 'variant') as vv from x group by 1),
w as (select split, (mc - mv) / sqrt(vc / n_control + vv / n_variant) as t,
 power(vc / n_control + vv / n_variant, 2) / (power(vc / n_control, 2) / (n_control - 1) + power(vv / n_variant, 2) / (n_variant - 1)) as df from s),
p as (select {t_p('t', 'df')} as p from w)
select count(*) as n_tests, count_if(p < 0.1)::bigint as n_significant, round(count_if(p < 0.1) / count(*), 6) as false_positive_rate from p""")
def _(spark, folder):
    # Repeated A/A splits of the customers take the place of made-up draws.
    tests = S.split_tests(units(spark, folder), "c_custkey", "n_delivered", N_AA, "aa")
    return I.false_positive_rate(tests, 0.1).withColumn("false_positive_rate", r("false_positive_rate"))


#: Power of the two-sided test at shift s, as an integral over the pooled deviation u (200 steps around 1) of two normal probabilities.
_U_WEIGHT = "(case when j in (0, 200) then 1 when j % 2 = 1 then 4 else 2 end)"


def _power(s, t, df):
    """Expressions: grid point u, its weight times density. Grouped by the caller."""
    inner = half_normal(f"({t} * u - {s})").replace("i in (0, 2000)", "i in (0, 400)").replace("range(0, 2001)", "range(0, 401)").replace("i / 2000", "i / 400").replace("/ 6000", "/ 1200")
    outer = half_normal(f"(-{t} * u - {s})").replace("i in (0, 2000)", "i in (0, 400)").replace("range(0, 2001)", "range(0, 401)").replace("i / 2000", "i / 400").replace("/ 6000", "/ 1200")
    density = f"exp(({df} / 2) * ln({df} / 2) + ln(2) - lgamma({df} / 2) + ({df} - 1) * ln(u) - {df} * u * u / 2)"
    return f"(1 - sum({_U_WEIGHT} * step / 3 * {density} * ({inner} - {outer})))"


_U = "1 - least(0.999, 9 / sqrt(2 * df)) + j * step as u"
_STEP = "(least(0.999, 9 / sqrt(2 * df)) + 9 / sqrt(2 * df)) / 200 as step"

@query("exact_power", f"""
with recursive {UNITS_CTE}, m as (select c_mktsegment, count(*) as n, avg(gmv) as mean, var_samp(gmv) as v, count(*) - 2.0::double as df from units group by 1),
b as (select c_mktsegment, df, 0.0::double as low, 20.0::double as high, 0 as k from m union all
 select c_mktsegment, df, case when p > 0.05 then (low + high) / 2 else low end, case when p > 0.05 then high else (low + high) / 2 end, k + 1
 from (select *, {t_p('((low + high) / 2)', 'df')} as p from b where k < 50)),
c as (select m.*, (low + high) / 2 as t, {_STEP.replace('df', 'm.df')}, sqrt(v * (1 / (n * 0.5) + 1 / (n * 0.5))) as se from m join b using (c_mktsegment) where k = 50),
grid as (select c.*, effect, abs(mean * effect) / se as s, j, {_U} from c, (select unnest([0.05, 0.1, 0.2, 0.4]::double[]) as effect), (select unnest(range(201)) as j)),
p as (select c_mktsegment, effect, any_value(s) as s, {_power('s', 't', 'df')} as power from grid group by all),
f as (select c_mktsegment, 0 as k, 2.8::double as s from c union all
 select c_mktsegment, any_value(k) + 1, any_value(s) - ({_power('s', 't', 'df')} - 0.8) / 0.28 from (select f.s, f.k, c.*, j, {_U} from f join c using (c_mktsegment), (select unnest(range(201)) as j) where k < 20) group by c_mktsegment)
select c_mktsegment, n as n_units, effect as relative_effect, round(p.s, 6) as standardised_effect, round(power, 6) as exact_power,
 round(0.5 + {half_normal('(p.s - 1.959963984540054)')} + 0.5 - {half_normal('(p.s + 1.959963984540054)')}, 6) as power, round(f.s * se, 4) as detectable_effect
from p join c using (c_mktsegment) join f using (c_mktsegment) where f.k = 20""")
def _(spark, folder):
    out = I.exact_power_curve(units(spark, folder), ["c_mktsegment"], "gmv", [0.05, 0.1, 0.2, 0.4], [0.5], alpha=0.05)
    return out.select(
        "c_mktsegment", "n_units", "relative_effect", r("standardised_effect").alias("standardised_effect"), r("exact_power").alias("exact_power"),
        r("power").alias("power"), r("detectable_effect", 4).alias("detectable_effect"),
    )
