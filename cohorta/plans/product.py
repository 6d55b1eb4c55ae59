"""Composite product-analytics queries: sessions, funnels, exposures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohorta.functions import columns as C
from cohorta.operators import activity as V
from cohorta.operators import aggregates as A
from cohorta.operators import exposure as E
from cohorta.operators import funnel as U
from cohorta.operators import inference as I
from cohorta.operators import joins as J
from cohorta.operators import nested as N
from cohorta.operators import reconcile as K
from cohorta.operators import reshape as W
from cohorta.operators.scans import last_known, ordered_scans
from cohorta.operators.splits import assign_by_hash
from cohorta.plans.base import (
    scan_table,
    EXPOSURES_CTE, SESSIONS_CTE, WINDOWS_CTE, events, exposures, lines, orders, query, r, sessions, windows,
    calm_users,
)

IS = lambda kind: F.col("event_type") == kind
# The user is part of the key although the session implies it: the scans before leave
# the rows partitioned by user, and the funnel can stay in that partitioning.
SESSION = ["user_id", "session_id", "day"]


@query("sessionize", f"with {SESSIONS_CTE} select event_id, session_id, session_start from sessions")
def _(spark, folder):
    return sessions(spark, folder).select("event_id", "session_id", "session_start")


# -- funnels ------------------------------------------------------------------

def sessions_with_variant(spark, folder, calm):
    s = sessions(spark, folder, calm)
    w = windows(spark, folder, calm).withColumnRenamed("customer_id", "user_id")
    return E.assign_variant(s, w, ["user_id"], "ts", how="left", hot=calm)


_FUNNEL = f"""
with {SESSIONS_CTE}, {WINDOWS_CTE},
s1 as (select s.session_id, s.day, s.ts, w.variant from sessions s
       left join windows w on w.customer_id = s.user_id and s.ts >= w.start_time and s.ts < w.end_time where event_type = 'view')"""


@query("session_funnel", _FUNNEL + """
select s1.day, s1.variant, count(distinct s1.session_id) as n_view, count(distinct s2.session_id) as n_click, count(distinct s3.session_id) as n_purchase
from s1 left join sessions s2 on s2.session_id = s1.session_id and s2.day = s1.day and s2.event_type = 'click' and s2.ts >= s1.ts
left join sessions s3 on s3.session_id = s2.session_id and s3.day = s2.day and s3.event_type = 'purchase' and s3.ts >= s2.ts group by all""")
def _(spark, folder):
    steps = [("view", IS("view")), ("click", IS("click")), ("purchase", IS("purchase"))]
    calm = calm_users(spark, folder)
    reached = U.session_funnel(sessions_with_variant(spark, folder, calm), SESSION, "ts", steps, ["variant"], coarse=["user_id"], hot=calm)
    return U.funnel_counts(reached, "session_id", ["view", "click", "purchase"], ["day", "variant"])


@query("session_funnel_anchored", _FUNNEL + """
select s1.day, s1.variant, count(distinct s1.session_id) as n_view, count(distinct s2.session_id) as n_click,
 count(distinct s3.session_id) as n_purchase, count(distinct s4.session_id) as n_error
from s1 left join sessions s2 on s2.session_id = s1.session_id and s2.day = s1.day and s2.event_type = 'click' and s2.ts > s1.ts
left join sessions s3 on s3.session_id = s1.session_id and s3.day = s1.day and s3.event_type = 'purchase' and s3.ts > s1.ts
left join sessions s4 on s4.session_id = s1.session_id and s4.day = s1.day and s4.event_type = 'error' and s4.ts > s1.ts group by all""")
def _(spark, folder):
    names = ["view", "click", "purchase", "error"]
    calm = calm_users(spark, folder)
    rows = sessions_with_variant(spark, folder, calm)
    reached = U.session_funnel(rows, SESSION, "ts", [(n, IS(n)) for n in names], ["variant"], "first", strict=True, coarse=["user_id"], hot=calm)
    return U.funnel_counts(reached, "session_id", names, ["day", "variant"])


@query("funnel_events_anchored", f"""
with {SESSIONS_CTE}
select s1.day, count(distinct s1.event_id) as n_view, count(distinct s2.event_id) as n_click, count(distinct s3.event_id) as n_purchase
from sessions s1 left join sessions s2 on s2.session_id = s1.session_id and s2.day = s1.day and s2.event_type = 'click' and s2.ts > s1.ts
left join sessions s3 on s3.session_id = s1.session_id and s3.day = s1.day and s3.event_type = 'purchase' and s3.ts > s1.ts
where s1.event_type = 'view' group by 1""")
def _(spark, folder):
    names = ["view", "click", "purchase"]
    calm = calm_users(spark, folder)
    s = sessions(spark, folder, calm)
    return U.funnel_events(s, SESSION, "ts", [(n, IS(n)) for n in names], ["day"], "first", strict=True, coarse=["user_id"], hot=calm)


@query("conversion_within", f"""
with {SESSIONS_CTE}
select a.day, count(distinct a.session_id) as n_started, count(distinct b.session_id) as n_converted
from sessions a left join sessions b on b.session_id = a.session_id and b.day = a.day and b.event_type = 'purchase'
 and b.ts between a.ts and a.ts + interval 60 minute where a.event_type = 'view' group by 1""")
def _(spark, folder):
    calm = calm_users(spark, folder)
    s = sessions(spark, folder, calm).select("user_id", "session_id", "day", "ts", "event_type")
    return U.conversion_within(s, IS("view"), IS("purchase"), SESSION, "ts", 3600, "session_id", ["day"], coarse=["user_id"], hot=calm)


_SURFACE_SQL = """case when event_type = 'purchase' and k % 11 = 0 then 'OrderAgain' when k < 20 then 'List' when k < 40 and value > 5 then 'ListBanner'
 when k < 60 then 'HomeBanner' when k < 75 then 'Search' else 'Other' end"""


@query("attribute_surface", f"""
with {SESSIONS_CTE},
s as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from sessions),
x as (select session_id, user_id, event_type, {_SURFACE_SQL} as surface, count(event_id) as n from s group by all)
select surface, count(i.n) as impression_sessions, count(a.n) as access_sessions, count(o.n) as order_sessions
from (select * from x where event_type = 'purchase') o
left join (select * from x where event_type = 'view') i using (session_id, user_id, surface)
left join (select * from x where event_type = 'click') a using (session_id, user_id, surface)
where surface in ('List', 'ListBanner', 'Search', 'OrderAgain', 'Other') group by 1""")
def _(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    rules = [
        (IS("purchase") & (k % 11 == 0), "OrderAgain"), (k < 20, "List"), ((k < 40) & (F.col("value") > 5), "ListBanner"),
        (k < 60, "HomeBanner"), (k < 75, "Search"),
    ]
    s = sessions(spark, folder).withColumn("surface", C.case_map(rules, "Other"))
    s = s.where(F.col("surface").isin("List", "ListBanner", "Search", "OrderAgain", "Other"))
    kinds = {"impression": "view", "access": "click", "order": "purchase"}
    # All three kinds meet in one aggregation; keys without an order drop out.
    per_key = s.groupBy("user_id", "session_id", "surface").agg(*[F.max(IS(v)).alias(n) for n, v in kinds.items()]).where("`order`")
    return per_key.groupBy("surface").agg(*[F.count_if(n if n != "order" else F.col("order")).alias(f"{n}_sessions") for n in kinds])


_POSITION_SQL = f"""
with {SESSIONS_CTE},
s as (select *, cast(json_extract_string(props, '$.k') as bigint) % 4 + 1 as position from sessions),
f as (select si.day, si.position, count(distinct si.event_id) as n_shown, count(distinct sa.event_id) as n_accessed, count(distinct oc.event_id) as n_ordered
 from s si left join s sa on sa.event_type = 'click' and si.day = sa.day and si.ts <= sa.ts and si.session_id = sa.session_id
 left join s oc on oc.event_type = 'purchase' and sa.day = oc.day and sa.ts <= oc.ts and sa.session_id = oc.session_id
 where si.event_type = 'view' group by all)"""


def _positions(spark, folder):
    # Only the first step carries a position; the group of later events does not matter.
    calm = calm_users(spark, folder)
    s = sessions(spark, folder, calm).withColumn("position", F.get_json_object("props", "$.k").cast("long") % 4 + 1)
    steps = [("shown", IS("view")), ("accessed", IS("click")), ("ordered", IS("purchase"))]
    return U.funnel_events(s, SESSION, "ts", steps, ["day", "position"], coarse=["user_id"], hot=calm)


@query("position_funnel", _POSITION_SQL + " select * from f")
def _(spark, folder):
    return _positions(spark, folder)


@query("position_ctr_cvr", _POSITION_SQL + " select day, " + ", ".join(
    f"round(sum(case when position = {p} then {c} end) / nullif(sum(case when position = {p} then n_shown end), 0), 6) as {n}_{p}"
    for p in (1, 2, 3, 4) for n, c in (("ctr", "n_accessed"), ("cvr", "n_ordered"))) + " from f group by 1")
def _(spark, folder):
    names = ["n_shown", "n_accessed", "n_ordered"]
    wide = W.pivot_metrics(_positions(spark, folder), ["day"], "position", [1, 2, 3, 4], {n: F.sum(n) for n in names})
    ratios = [
        r(C.safe_ratio(F.coalesce(F.col(f"{c}_{p}"), F.when(F.col(f"n_shown_{p}").isNotNull(), F.lit(0))), f"n_shown_{p}")).alias(f"{n}_{p}")
        for p in (1, 2, 3, 4) for n, c in (("ctr", "n_accessed"), ("cvr", "n_ordered"))
    ]
    return wide.select("day", *ratios)


@query("nearest_follow_up", f"""
with {SESSIONS_CTE},
f as (select distinct session_id, user_id, ts from sessions where event_type = 'error' qualify dense_rank() over (partition by session_id order by ts) = 1),
p as (select f.session_id, f.user_id, s.event_id, date_sub('second', f.ts, s.ts) as delta_seconds,
 case when s.session_id is not null then case when f.session_id = s.session_id then 1 else 0 end end as is_same_session,
 rank() over (partition by f.session_id order by date_sub('second', f.ts, s.ts)) as rk
 from f left join sessions s on s.event_type = 'view' and f.user_id = s.user_id and f.ts <= s.ts and date_sub('second', f.ts, s.ts) <= 86400)
select session_id, user_id, event_id, delta_seconds, is_same_session from p where rk = 1""")
def _(spark, folder):
    calm = calm_users(spark, folder)
    s = sessions(spark, folder, calm).select("event_id", "session_id", "user_id", "ts", "event_type")
    return U.nearest_follow_up(
        s.where(IS("error")).select("session_id", "user_id", "ts"), s.where(IS("view")), "user_id", "session_id", "ts", "ts", ["event_id"], 86400, hot=calm
    )


_GAP = """date_sub('second', f.ts, g.ts)"""


@query("time_gap_pairs", f"""
select g.event_id as later_id, f.event_id as earlier_id, {_GAP} as delta_seconds,
 case when {_GAP} > 0 and {_GAP} <= 3600 then 'within an hour' when {_GAP} > 3600 and {_GAP} <= 14400 then 'within four hours' when {_GAP} > 14400 then 'within a day' end as bucket
from events g join events f on g.user_id = f.user_id and g.ts >= f.ts and {_GAP} <= 86400 and f.event_type = 'click' where g.event_type = 'purchase'
qualify row_number() over (partition by g.event_id order by f.ts desc, f.event_id desc) = 1""")
def _(spark, folder):
    # The closest earlier click of each purchase, in one scan per user; all pairs are only counted, in time_gap_buckets.
    e = events(spark, folder, "event_id", "ts", "user_id", "event_type").where(IS("click") | IS("purchase"))
    e = e.withColumn("_later", IS("purchase").cast("int")).withColumn("_click", F.when(IS("click"), F.struct("event_id", "ts")))
    found = ordered_scans(e, ["user_id"], ["ts", "_later", "event_id"], {"_c": last_known("_click")}, match_nulls=False).where(IS("purchase"))
    pairs = found.select(F.col("event_id").alias("later_id"), F.col("_c.event_id").alias("earlier_id"), C.seconds_between("_c.ts", "ts").alias("delta_seconds")).where("delta_seconds <= 86400")
    d = F.col("delta_seconds")
    bucket = C.case_map([((d > 0) & (d <= 3600), "within an hour"), ((d > 3600) & (d <= 14400), "within four hours"), (d > 14400, "within a day")])
    return pairs.select("later_id", "earlier_id", "delta_seconds", bucket.alias("bucket"))


@query("time_gap_buckets", f"""
with p as (select {_GAP} as d from events g join events f on g.user_id = f.user_id and g.ts >= f.ts and {_GAP} <= 86400 and f.event_type = 'click' where g.event_type = 'purchase'),
b as (select * from (values (-1, 0), (0, 3600), (3600, 14400), (14400, 86400)) v(gap_from, gap_to))
select gap_from, gap_to, count(d) as n_pairs from b left join p on d > gap_from and d <= gap_to group by all""")
def _(spark, folder):
    e = events(spark, folder, "ts", "user_id", "event_type")
    return U.follow_up_counts(e.where(IS("click")), e.where(IS("purchase")), ["user_id"], "ts", [-1, 0, 3600, 14400, 86400])


_SELL = ", ".join(
    f"round(count(distinct f.event_id) filter (where {t}.event_id is not null{c}) / count(distinct f.event_id), 6) as {n}{s}"
    for t, n in (("g", "same_session"), ("h", "within_24h"))
    for c, s in (("", ""), (f" and {t}.channel = 'ad'", "_ad"), (f" and {t}.channel = 'other'", "_other"))
)


@query("cross_sell_rate", f"""
with {SESSIONS_CTE},
s as (select *, case when cast(json_extract_string(props, '$.k') as bigint) % 3 = 0 then 'ad' else 'other' end as channel from sessions)
select count(distinct f.event_id) as n_starts, {_SELL} from s f
left join s g on g.event_type = 'purchase' and f.ts <= g.ts and f.user_id = g.user_id and f.session_id = g.session_id
left join s h on h.event_type = 'purchase' and f.ts <= h.ts and f.user_id = h.user_id and date_sub('second', f.ts, h.ts) <= 86400
where f.event_type = 'click'""")
def _(spark, folder):
    channel = F.when(F.get_json_object("props", "$.k").cast("long") % 3 == 0, "ad").otherwise("other")
    calm = calm_users(spark, folder)
    s = sessions(spark, folder, calm).withColumn("channel", channel).select("event_id", "user_id", "session_id", "ts", "event_type", "channel")
    picks = lambda n: {n: F.lit(True), f"{n}_ad": F.col("channel") == "ad", f"{n}_other": F.col("channel") == "other"}
    marked = U.mark_starts(s, IS("click"), IS("purchase"))
    same = U.with_next_times(marked, ["user_id", "session_id"], "ts", picks("same_session"), hot=calm)
    found = U.with_next_times(same, ["user_id"], "ts", picks("within_24h"), hot=calm).where("_kind = 0")
    rates = [r(C.safe_ratio(F.count_if(F.col(n).isNotNull()), F.count(F.lit(1)))).alias(n) for n in picks("same_session")]
    rates += [r(C.safe_ratio(F.count_if(C.seconds_between("ts", n) <= 86400), F.count(F.lit(1)))).alias(n) for n in picks("within_24h")]
    return found.agg(F.count(F.lit(1)).alias("n_starts"), *rates)


# -- retention ----------------------------------------------------------------

@query("subsequent_orders", """
with d as (select *, cast(o_orderdate as date) as day, o_orderpriority in ('1-URGENT', '2-HIGH') as is_fresh,
           case when o_orderstatus = 'F' then 'done' else 'open' end as segment from orders)
select o.o_orderkey, count(distinct n.o_orderkey) as orders_after, count(distinct case when n.is_fresh then n.o_orderkey end) as flagged_orders_after
from d o left join d n on o.o_custkey = n.o_custkey and o.o_orderkey <> n.o_orderkey and n.day >= o.day and n.day <= o.day + 28 and o.segment = n.segment group by 1""")
def _(spark, folder):
    o = orders(spark, folder).withColumn("segment", F.when(F.col("o_orderstatus") == "F", "done").otherwise("open"))
    out = V.subsequent_orders(o, ["o_custkey", "segment"], "day", 28, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return out.select("o_orderkey", "orders_after", "flagged_orders_after")


@query("retention_flag", """
select o_orderkey, lead(cast(o_orderdate as date)) over w as next_day,
 coalesce(lead(cast(o_orderdate as date)) over w - cast(o_orderdate as date) <= 28, false) as is_retained
from orders window w as (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey)""")
def _(spark, folder):
    out = V.retention(orders(spark, folder), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"], "day", 28)
    return out.select("o_orderkey", "next_day", "is_retained")


@query("trailing_leading_activity", """
with d as (select *, cast(o_orderdate as date) as day from orders)
select o_orderpriority, count(*) as n_orders, sum(n_before) as orders_before, sum(n_after) as orders_after, round(avg(v_after), 4) as mean_value_after from (
 select o_orderpriority, count(*) over (partition by o_custkey order by day range between interval 31 day preceding and interval 1 day preceding) as n_before,
  count(*) over (partition by o_custkey order by day range between interval 1 day following and interval 31 day following) as n_after,
  coalesce(sum(o_totalprice) over (partition by o_custkey order by day range between interval 1 day following and interval 31 day following), 0) as v_after from d) group by 1""")
def _(spark, folder):
    o = orders(spark, folder)
    out = V.activity_around(o, ["o_custkey"], "day", F.col("o_totalprice"), F.lit(True), {"before": (-31, -1), "after": (1, 31)})
    return out.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("n_before").alias("orders_before"), F.sum("n_after").alias("orders_after"), r(F.avg("value_after"), 4).alias("mean_value_after")
    )


@query("customer_tenure_months", """
with f as (select o_custkey, cast(min(o_orderdate) as date) as first_day from orders group by 1)
select (cast(o_orderdate as date) - first_day) // 28 as tenure, count(*) as n_orders from orders join f using (o_custkey) group by 1""")
def _(spark, folder):
    o = orders(spark, folder).select("o_custkey", "day")
    first = o.groupBy("o_custkey").agg(F.min("day").alias("first_day"))
    return o.join(first, "o_custkey").groupBy(C.tenure_periods("first_day", "day").alias("tenure")).agg(F.count(F.lit(1)).alias("n_orders"))


# -- exposures ----------------------------------------------------------------

@query("first_exposure", f"with {EXPOSURES_CTE} select customer_id, variant, min(ts) as first_exposure_at from exposures group by all")
def _(spark, folder):
    return E.first_exposure(exposures(spark, folder), ["customer_id", "variant"], "ts")


@query("pre_exposure_period", f"""
with {WINDOWS_CTE}
select customer_id, variant, start_time, end_time from windows union all
select customer_id, 'before exposure', timestamp '2024-01-01', min(start_time) from windows group by 1 having min(start_time) > timestamp '2024-01-01'""")
def _(spark, folder):
    return E.with_pre_exposure(windows(spark, folder), ["customer_id"], F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


_PROMO = "cast(json_extract_string(props, '$.k') as bigint)"


@query("filtered_exposure", f"""
with {EXPOSURES_CTE},
t as (select user_id as customer_id, ts, case when {_PROMO} % 5 <> 0 then case when {_PROMO} % 3 = 0 then [-1] else [{_PROMO}, -1] end end as ids,
      case when {_PROMO} % 2 = 0 then ['FLAT'] else ['PERCENT', 'OTHER'] end as types from events where event_type = 'view'),
q as (select t.customer_id, min(t.ts) as touch from t join (select customer_id, min(ts) as exposed from exposures group by 1) x on x.customer_id = t.customer_id and t.ts >= x.exposed
      where ids is not null and not (len(ids) = 1 and list_contains(ids, -1)) and (list_contains(types, 'PERCENT') or list_contains(types, 'TWO')) group by 1)
select customer_id, variant, cast(touch as date) as first_exposure_at from exposures join q using (customer_id) where touch >= ts group by all""")
def _(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    touches = events(spark, folder).where(IS("view")).select(
        F.col("user_id").alias("customer_id"), F.col("ts").alias("touched_at"),
        F.when(k % 5 != 0, F.when(k % 3 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array(k, F.lit(-1).cast("long")))).alias("ids"),
        F.when(k % 2 == 0, F.array(F.lit("FLAT"))).otherwise(F.array(F.lit("PERCENT"), F.lit("OTHER"))).alias("types"),
    )
    condition = N.promoted("ids", "types", ["PERCENT", "TWO"])
    return E.filtered_exposure(exposures(spark, folder), touches, ["customer_id"], "ts", "touched_at", condition)


@query("exposure_split_check", f"""
with {EXPOSURES_CTE}, d as (select distinct cast(ts as date) as day, customer_id, variant from exposures where customer_id is not null)
select day, count_if(variant = 'control')::bigint as n_control, count_if(variant = 'treatment')::bigint as n_treatment,
 round(count_if(variant = 'control') / count(*), 6) as share_control, round(count_if(variant = 'treatment') / count(*), 6) as share_treatment from d group by 1""")
def _(spark, folder):
    out = E.exposure_split(exposures(spark, folder), F.to_date("ts"), "customer_id", ["control", "treatment"])
    return out.withColumn("share_control", r("share_control")).withColumn("share_treatment", r("share_treatment"))


@query("conflict_customers", """
with e as (select user_id as customer_id, case when value < 1 then null when value < 3 then 'forced' when event_id % 2 = 0 then 'control' else 'treatment' end as variant
           from events where event_type = 'signup')
select distinct customer_id from e where variant is null or variant not in ('control', 'treatment')""")
def _(spark, folder):
    return E.conflict_customers(_messy_exposures(spark, folder), "customer_id", ["control", "treatment"])


def _messy_exposures(spark, folder):
    e = events(spark, folder, "event_id", "user_id", "value", "event_type").where(IS("signup"))
    variant = F.when(F.col("value") < 1, F.lit(None)).when(F.col("value") < 3, "forced").when(F.col("event_id") % 2 == 0, "control").otherwise("treatment")
    return e.select(F.col("user_id").alias("customer_id"), variant.alias("variant"))


@query("without_conflict_customers", """
with e as (select user_id as customer_id, case when value < 1 then null when value < 3 then 'forced' when event_id % 2 = 0 then 'control' else 'treatment' end as variant
           from events where event_type = 'signup')
select customer_id, count(*) as n from e where customer_id not in (select customer_id from e where variant is null or variant not in ('control', 'treatment')) group by 1""")
def _(spark, folder):
    e = _messy_exposures(spark, folder)
    clean = e.join(E.conflict_customers(e, "customer_id", ["control", "treatment"]), "customer_id", "left_anti")
    return clean.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))


@query("exposures_by_day", f"""
with {EXPOSURES_CTE}, f as (select customer_id, variant, min(ts) as t from exposures group by all)
select cast(t as date) as exposure_day, variant, count(distinct customer_id) as n_customers from f group by all""")
def _(spark, folder):
    return E.exposures_by_day(exposures(spark, folder), "customer_id", "ts")


@query("orders_with_variant", f"""
with {WINDOWS_CTE}
select e.event_id, e.user_id as customer_id, w.variant, e.value from events e
join windows w on w.customer_id = e.user_id and e.ts >= w.start_time and e.ts < w.end_time
where e.event_type = 'purchase' and cast(json_extract_string(e.props, '$.k') as bigint) in (select s_suppkey from supplier where s_acctbal > 3000)""")
def _(spark, folder):
    # The number in an event's properties plays the store id.
    k = F.get_json_object("props", "$.k").cast("long")
    buys = events(spark, folder).where(IS("purchase")).select("event_id", F.col("user_id").alias("customer_id"), "ts", "value", k.alias("store_id"))
    chosen = J.in_ids(buys, "store_id", scan_table(spark, folder, "supplier", ["s_suppkey", "s_acctbal"]).where("s_acctbal > 3000"), "s_suppkey")
    return E.assign_variant(chosen, windows(spark, folder), ["customer_id"], "ts").select("event_id", "customer_id", "variant", "value")


@query("new_vs_recurrent_split", f"""
with {SESSIONS_CTE},
known as (select session_id, case when avg(value) > 12 then true when avg(value) > 5 then false end as is_recurrent from sessions group by 1)
select day, {", ".join(f"count(distinct case when {c} then session_id end) as {n}" for n, c in (
 ("all_sessions", "true"), ("recurrent_sessions", "is_recurrent"), ("new_sessions", "is_recurrent = false"), ("unknown_sessions", "is_recurrent is null"),
 ("recurrent_buying", "is_recurrent and event_type = 'purchase'"), ("new_buying", "is_recurrent = false and event_type = 'purchase'")))}
from sessions join known using (session_id) group by 1""")
def _(spark, folder):
    s = sessions(spark, folder)
    # Sessions are made once; a window over a session sees one row per day of it.
    daily = s.groupBy("user_id", "session_id", "day").agg(F.sum("value").alias("v"), F.count("value").alias("n"), F.max(IS("purchase")).alias("buys"))
    whole = Window.partitionBy("user_id", "session_id")
    daily = daily.withColumn("m", C.safe_ratio(F.sum("v").over(whole), F.sum("n").over(whole))).where("session_id is not null")
    daily = daily.withColumn("is_recurrent", F.when(F.col("m") > 12, True).when(F.col("m") > 5, False))
    rec, buy = F.col("is_recurrent"), F.col("buys")
    return daily.groupBy("day").agg(
        F.count(F.lit(1)).alias("all_sessions"), F.count_if(rec).alias("recurrent_sessions"), F.count_if(~rec).alias("new_sessions"),
        F.count_if(rec.isNull()).alias("unknown_sessions"), F.count_if(rec & buy).alias("recurrent_buying"), F.count_if(~rec & buy).alias("new_buying"),
    )


@query("map_event_to_category", """
with e as (select *, cast(json_extract_string(props, '$.k') as bigint) as k, cast(ts as date) as day from events),
a as (select distinct day, k % 10 as id, case when k % 4 = 0 then 'Seasonal' when k % 2 = 0 then 'Food' else 'Household' end as category from e where event_type = 'click' and value > 30),
b as (select distinct day, k % 7 as group_id, case when k % 7 < 3 then 'Food' else 'Health' end as category from e where event_type = 'error')
select e.event_id, coalesce(a.category, b.category) as category from e left join a on a.day = e.day and a.id = e.k % 10
left join b on b.day = e.day and b.group_id = e.k % 7 where e.event_type = 'view'""")
def _(spark, folder):
    e = events(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("day", F.to_date("ts"))
    e = e.withColumn("id", F.col("k") % 10).withColumn("group_id", F.col("k") % 7)
    first = e.where(IS("click") & (F.col("value") > 30)).withColumn("category", C.case_map([(F.col("k") % 4 == 0, "Seasonal"), (F.col("k") % 2 == 0, "Food")], "Household"))
    second = e.where(IS("error")).withColumn("category", F.when(F.col("group_id") < 3, "Food").otherwise("Health"))
    views = e.where(IS("view")).select("event_id", "day", "id", "group_id")
    return J.category_from_maps(views, first, ["day", "id"], second, ["day", "group_id"], "category").select("event_id", "category")


@query("taps_per_session", f"""
with {SESSIONS_CTE},
s as (select day, count(distinct session_id) as n_sessions from sessions where event_type = 'view' group by 1),
t as (select cast(ts as date) as day, count(case when cast(json_extract_string(props, '$.k') as bigint) < 50 then event_id end) as low_taps, count(event_id) as all_taps
      from events where event_type = 'click' group by 1)
select round(sum(low_taps) / sum(n_sessions), 6) as low_taps_per_session, round(sum(all_taps) / sum(n_sessions), 6) as taps_per_session from s left join t using (day)""")
def _(spark, folder):
    s = sessions(spark, folder).where(IS("view")).groupBy("day").agg(F.countDistinct("session_id").alias("n_sessions"))
    e = events(spark, folder, "ts", "props", "event_type").where(IS("click"))
    t = e.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.get_json_object("props", "$.k").cast("long") < 50).alias("low_taps"), F.count(F.lit(1)).alias("all_taps"))
    out = A.ratio_of_sums(s.join(t, "day", "left"), [], {"low_taps_per_session": ("low_taps", "n_sessions"), "taps_per_session": ("all_taps", "n_sessions")})
    return out.select(r("low_taps_per_session").alias("low_taps_per_session"), r("taps_per_session").alias("taps_per_session"))


@query("daily_counts", f"""
with {SESSIONS_CTE}
select day, event_type, count(*) as n_events, count(distinct user_id) as n_users, count(distinct session_id) as n_sessions from sessions group by all""")
def _(spark, folder):
    per_session = sessions(spark, folder).groupBy("day", "event_type", "user_id", "session_id").agg(F.count(F.lit(1)).alias("n"))
    per_user = per_session.groupBy("day", "event_type", "user_id").agg(F.sum("n").alias("n"), F.count("session_id").alias("s"))
    # A session belongs to one user, so users' session counts add up.
    return per_user.groupBy("day", "event_type").agg(F.sum("n").alias("n_events"), F.count("user_id").alias("n_users"), F.sum("s").alias("n_sessions"))


@query("reconcile_counts", """
with a as (select cast(o_orderdate as date) as day, count(*) as n_orders from orders group by 1),
b as (select cast(l_shipdate as date) as day, count(*) as n_lines from lineitem group by 1),
c as (select cast(o_orderdate as date) as day, count(*) as n_delivered from orders where o_orderstatus = 'F' group by 1)
select coalesce(a.day, b.day, c.day) as day, coalesce(n_orders, 0) as n_orders, coalesce(n_lines, 0) as n_lines, coalesce(n_delivered, 0) as n_delivered
from a full join b on a.day = b.day full join c on coalesce(a.day, b.day) = c.day""")
def _(spark, folder):
    o = orders(spark, folder)
    l = lines(spark, folder, "l_shipdate").select(F.to_date("l_shipdate").alias("day"))
    return K.reconcile_counts({"orders": o, "lines": l, "delivered": o.where("o_orderstatus = 'F'")}, ["day"])


@query("missing_keys", """
select distinct o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def _(spark, folder):
    l = lines(spark, folder, "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")
    return K.missing_keys(scan_table(spark, folder, "orders", ["o_orderkey"]), l, ["o_orderkey"])


@query("sample_ratio_check", """
with n as (select count_if(v = 'control')::bigint as n_control, count_if(v = 'variant')::bigint as n_variant from
 (select case when cast('0x' || substr(md5('srm' || c_custkey), 1, 8) as bigint) % 1000 < 500 then 'control' else 'variant' end as v from customer)),
c as (select *, power(n_control - (n_control + n_variant) * 0.5, 2) / ((n_control + n_variant) * 0.5) + power(n_variant - (n_control + n_variant) * 0.5, 2) / ((n_control + n_variant) * 0.5) as x from n)
select n_control, n_variant, round(x, 6) as chi_square,
 round(1 - (sqrt(x) / 2000 / 3) * list_sum(list_transform(range(0, 2001), lambda i: (case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end)
   * 2 * exp(-power(sqrt(x) * i / 2000, 2) / 2) / sqrt(2 * pi()))), 6) as p_value from c""")
def _(spark, folder):
    c = assign_by_hash(scan_table(spark, folder, "customer", ["c_custkey"]), "c_custkey", "srm", [(500, "control"), (1000, "variant")])
    counts = c.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    out = I.sample_ratio_check(counts, [], "variant", "n", {"control": 0.5, "variant": 0.5})
    return out.withColumn("chi_square", r("chi_square")).withColumn("p_value", r("p_value"))
