"""Small hand-made frames for the corners of each operator."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohorta.functions import columns as C
from cohorta.functions import distributions as D
from cohorta.operators import activity, aggregates, basket, exposure, funnel, inference, joins, nested, ranks, reconcile, reshape, rows, spine, splits
from cohorta.sources import tables

T0 = datetime(2024, 1, 1, 12)


def at(**kw):
    return T0 + timedelta(**kw)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- exposures ----------------------------------------------------------------

@pytest.fixture()
def windows(spark):
    e = spark.createDataFrame(
        [("x", 1, "a", at()), ("x", 2, "b", at(hours=1)), ("x", 3, "a", at(hours=1)), ("y", 4, "b", at(hours=2))],
        "customer string, n int, variant string, ts timestamp_ntz",
    )
    return exposure.exposure_windows(e, ["customer"], "ts", F.lit(at(hours=9)).cast("timestamp_ntz"), ["n"])


def test_windows_do_not_overlap_and_ties_are_empty(windows):
    got = rows_of(windows.select("customer", "n", "start_time", "end_time"))
    assert got == [("x", 1, at(), at(hours=1)), ("x", 2, at(hours=1), at(hours=1)), ("x", 3, at(hours=1), at(hours=9)), ("y", 4, at(hours=2), at(hours=9))]


def test_border_event(spark, windows):
    e = spark.createDataFrame([("x", 1, at(hours=1)), ("x", 2, at(hours=9)), ("x", 3, at(hours=-1)), ("z", 4, at())], "customer string, id int, ts timestamp_ntz")
    half = exposure.assign_variant(e, windows, ["customer"], "ts").select("id", "variant")
    assert rows_of(half) == [(1, "a")]
    left = exposure.assign_variant(e, windows, ["customer"], "ts", how="left").select("id", "variant")
    assert rows_of(left) == [(1, "a"), (2, None), (3, None), (4, None)]
    closed = exposure.assign_variant_closed(e, windows, ["customer"], "ts").select("id", "variant")
    assert rows_of(closed) == [(1, "a"), (1, "a"), (1, "b"), (2, "a")]
    closed_left = exposure.assign_variant_closed(e, windows, ["customer"], "ts", how="left").select("id", "variant")
    assert rows_of(closed_left) == [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None), (4, None)]


def test_two_experiments_keep_apart(spark):
    e = spark.createDataFrame([("p", "x", at()), ("q", "x", at(hours=1)), ("p", "x", at(hours=2))], "experiment string, customer string, ts timestamp_ntz")
    w = exposure.exposure_windows(e, ["experiment", "customer"], "ts", F.lit(at(hours=9)).cast("timestamp_ntz"))
    assert ("p", at(), at(hours=2)) in rows_of(w.select("experiment", "start_time", "end_time"))


def test_active_windows_by_day_counts_both_ends(spark):
    w = spark.createDataFrame(
        [("a", datetime(2024, 1, 1), datetime(2024, 1, 3)), ("a", datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2)), ("b", datetime(2023, 12, 1), datetime(2024, 1, 2, 5)),
         (None, datetime(2024, 1, 2, 1), datetime(2024, 1, 9))],
        "variant string, start_time timestamp_ntz, end_time timestamp_ntz",
    )
    days = spine.date_spine(spark, date(2024, 1, 1), date(2024, 1, 4))
    got = rows_of(exposure.active_windows_by_day(w, days, ["a", "b", None]).select("calendar_date", "n_a", "n_b", "n_null"))
    assert [r[1:] for r in got] == [(1, 1, 0), (1, 1, 0), (1, 0, 1), (0, 0, 1)]


# -- sessions and funnels -----------------------------------------------------

def funnel_frame(spark, data):
    return spark.createDataFrame(data, "s string, day date, ts timestamp_ntz, kind string, dim string")


def steps():
    return [(n, F.col("kind") == n) for n in ("view", "click", "buy")]


def run(df, **kw):
    return rows_of(funnel.session_funnel(df, ["s", "day"], "ts", steps(), **kw).select("s", "day", *[F.col(f"t_{n}").isNotNull() for n, _ in steps()]))


def test_funnel_order_matters(spark):
    d = date(2024, 1, 1)
    df = funnel_frame(spark, [("p", d, at(), "click", None), ("p", d, at(minutes=1), "view", None), ("p", d, at(minutes=2), "buy", None),
                              ("q", d, at(), "view", None), ("q", d, at(), "click", None), ("q", d, at(), "buy", None)])
    assert run(df) == [("p", d, True, False, False), ("q", d, True, True, True)]
    assert run(df, anchor="first") == [("p", d, True, False, True), ("q", d, True, True, True)]
    assert run(df, anchor="first", strict=True) == [("p", d, True, False, True), ("q", d, True, False, False)]


def test_funnel_middle_step_must_come_between(spark):
    d = date(2024, 1, 1)
    df = funnel_frame(spark, [("p", d, at(), "view", None), ("p", d, at(minutes=1), "buy", None), ("p", d, at(minutes=2), "click", None)])
    assert run(df) == [("p", d, True, True, False)]


def test_funnel_across_midnight_is_two_days(spark):
    df = funnel_frame(spark, [("p", date(2024, 1, 1), at(hours=11), "view", None), ("p", date(2024, 1, 2), at(hours=13), "click", None)])
    assert run(df) == [("p", date(2024, 1, 1), True, False, False)]


def test_funnel_dims_come_from_first_step(spark):
    d = date(2024, 1, 1)
    df = funnel_frame(spark, [("p", d, at(), "view", "a"), ("p", d, at(minutes=1), "click", "zzz"), ("p", d, at(minutes=2), "view", None), ("p", d, at(minutes=3), "click", None)])
    counts = funnel.funnel_events(df, ["s", "day"], "ts", steps()[:2], ["dim"])
    assert rows_of(counts) == [("a", 1, 2), (None, 1, 1)]


def test_session_gap_is_exclusive(spark):
    df = spark.createDataFrame([("u", at()), ("u", at(minutes=30)), ("u", at(minutes=60, seconds=1))], "u string, ts timestamp_ntz")
    got = funnel.sessionize(df, "u", "ts", 1800).select("ts", "session_start")
    assert [r[1] for r in rows_of(got)] == [at(), at(), at(minutes=60, seconds=1)]


def test_follow_up_on_limit_and_none(spark):
    a = spark.createDataFrame([("u", at()), ("v", at())], "u string, ts timestamp_ntz")
    b = spark.createDataFrame([("u", at(hours=24)), ("v", at(hours=24, seconds=1))], "u string, ts timestamp_ntz")
    assert rows_of(funnel.next_within(a, b, ["u"], "ts", "ts", 86400).select("u", "followed_at")) == [("u", at(hours=24)), ("v", None)]


def test_nearest_follow_up_keeps_ties_of_a_second(spark):
    touches = spark.createDataFrame([("s", "u", at()), ("s", "u", at(seconds=5)), ("t", "w", at())], "s string, u string, ts timestamp_ntz")
    accesses = spark.createDataFrame([("s", "u", at(seconds=9, milliseconds=100), 1), ("r", "u", at(seconds=9, milliseconds=900), 2), ("s", "u", at(seconds=10), 3)],
                                     "s string, u string, ts timestamp_ntz, store int")
    got = funnel.nearest_follow_up(touches, accesses, "u", "s", "ts", "ts", ["store"], 86400)
    assert rows_of(got.select("s", "store", "delta_seconds", "is_same_session")) == [("s", 1, 9, 1), ("s", 2, 9, 0), ("t", None, None, None)]


def test_interval_join_is_all_pairs_in_range(spark):
    left = spark.range(40).selectExpr("id % 3 as k", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7) as a", "id as i")
    right = spark.range(60).selectExpr("id % 3 as k", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 5) as b", "id as j")
    got = joins.interval_join(left, right, ["k"], "a", "b", 30).select("i", "j")
    want = [(i, j) for i in range(40) for j in range(60) if i % 3 == j % 3 and 0 <= j * 5 - i * 7 <= 30]
    assert rows_of(got) == sorted(want, key=repr)


def test_follow_up_counts_match_pairs(spark):
    a = spark.range(30).selectExpr("id % 2 as k", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7) as t")
    b = spark.range(50).selectExpr("id % 2 as k", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 4.5) as t")
    got = rows_of(funnel.follow_up_counts(a, b, ["k"], "t", [-1, 0, 20, 100]))
    gaps = [int(j * 4.5 - i * 7) for i in range(30) for j in range(50) if i % 2 == j % 2 and j * 4.5 >= i * 7]
    want = [(lo, hi, sum(lo < g <= hi for g in gaps)) for lo, hi in ((-1, 0), (0, 20), (20, 100))]
    assert sorted(got) == want


# -- retention ----------------------------------------------------------------

def test_retention_on_day_28_and_29(spark):
    d = date(2024, 1, 1)
    df = spark.createDataFrame([("u", d), ("u", d + timedelta(28)), ("u", d + timedelta(57)), (None, d), (None, d)], "u string, day date")
    got = activity.retention(df, ["u"], ["day"], "day", 28).select("u", "day", "is_retained")
    assert rows_of(got) == sorted([("u", d, True), ("u", d + timedelta(28), False), ("u", d + timedelta(57), False), (None, d, False), (None, d, False)], key=repr)
    counted = activity.retention(df, ["u"], ["day"], "day", 28, null_keys=True).where("u is null")
    assert counted.where("is_retained").count() == 1


def test_subsequent_orders_count_same_day_but_not_self(spark):
    d = date(2024, 1, 1)
    df = spark.createDataFrame([(1, "u", d, True), (2, "u", d, False), (3, "u", d + timedelta(28), True), (4, "u", d + timedelta(57), None)], "id int, u string, day date, fresh boolean")
    got = activity.subsequent_orders(df, ["u"], "day", 28, F.col("fresh")).select("id", "orders_after", "flagged_orders_after")
    assert rows_of(got) == [(1, 2, 1), (2, 2, 2), (3, 0, 0), (4, 0, 0)]


def test_activity_frames_leave_out_the_day_itself(spark):
    d = date(2024, 3, 1)
    df = spark.createDataFrame([(1, "u", d, 10.0), (2, "u", d, 20.0), (3, "u", d + timedelta(31), 5.0), (4, "u", d + timedelta(32), 7.0)], "id int, u string, day date, v double")
    got = activity.activity_around(df, ["u"], "day", F.col("v"), F.lit(True), {"after": (1, 31), "before": (-31, -1)})
    assert rows_of(got.select("id", "n_after", "value_after", "n_before", "average_before")) == [
        (1, 1, 5.0, 0, 0.0), (2, 1, 5.0, 0, 0.0), (3, 1, 7.0, 2, 15.0), (4, 0, 0.0, 1, 5.0)]


# -- aggregates, ranks, reshaping ---------------------------------------------

def test_fanout_safe_sum_equals_unjoined_sum(spark):
    one = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, None)], "k int, v double")
    many = one.join(spark.range(4).select("id"), F.col("id") >= 0).withColumn("g", F.lit("x"))
    assert rows_of(aggregates.fanout_safe_sum(many, ["g"], ["k"], "v")) == [("x", 20.0)]
    assert rows_of(aggregates.fanout_safe_avg(many, ["g"], ["k"], "v")) == [("x", 10.0)]
    assert rows_of(aggregates.fanout_safe_avg(many.where("v is null"), ["g"], ["k"], "v")) == [("x", None)]


def test_composite_distinct_ignores_null_parts(spark):
    df = spark.createDataFrame([("g", 1, 2), ("g", 1, 2), ("g", 1, None), ("g", 11, 2), ("g", 1, 12)], "g string, a int, b int")
    assert rows_of(aggregates.conditional_distinct(df, ["g"], ["a", "b"], {"n": F.lit(True), "big": F.col("b") > 5})) == [("g", 3, 1)]


def test_grain(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows_of(aggregates.grain_audit(df, ["k"])) == [(3, 2)]
    with pytest.raises(ValueError):
        aggregates.assert_unique(df, ["k"])
    assert aggregates.assert_unique(df.distinct(), ["k"]).count() == 2


@pytest.mark.parametrize("limit", [10**6, 1])
@pytest.mark.parametrize("n", [1, 4, 5])
def test_percentiles_even_and_odd(spark, n, limit):
    df = spark.range(1, n + 1).selectExpr("cast(id as double) as v")
    got = ranks.percentiles(df, [], "v", {"q": 0.25, "m": 0.5, "h": 1.0}, group_limit=limit).first()
    assert tuple(got) == (1 + (n - 1) * 0.25, 1 + (n - 1) * 0.5, float(n))


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(1,), (1,), (5,), (7,)], "v int")
    got = ranks.ranked(df, [], "v").select("v", "rank_min", "rank_dense", "rank_avg", F.round("rank_percent", 4))
    assert rows_of(got) == [(1, 1, 1, 1.5, 0.0), (1, 1, 1, 1.5, 0.0), (5, 3, 2, 3.0, 0.6667), (7, 4, 3, 4.0, 1.0)]
    assert ranks.ranked(df.limit(1), [], "v").first().rank_percent == 0.0


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(3.0,)] * 4 + [(None,)], "v double")
    got = reshape.histogram(df, "v", 5)
    assert [r.n for r in got.orderBy("bin").collect()] == [4, 0, 0, 0, 0]


def test_histogram_shares_end_at_one(spark):
    got = reshape.histogram(spark.range(101).selectExpr("id as v"), "v", 10).orderBy("bin").collect()
    assert [r.n for r in got] == [10] * 9 + [11] and got[-1].cumulative == 1.0
    assert abs(sum(r.density * (r.bin_to - r.bin_from) for r in got) - 1) < 1e-12


def test_rolling_mean_waits_for_its_rows(spark):
    df = spark.range(4).selectExpr("id as day", "id * 1.0D as v")
    got = ranks.rolling_mean(df, [], "day", "v", 3, 3).orderBy("day").collect()
    assert [r.rolling_mean for r in got] == [None, None, 1.0, 2.0]


def test_drop_all_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c")], "k int, v string")
    assert rows_of(rows.drop_all_duplicates(df, ["k"])) == [(2, None), (None, "c")]


def test_keep_smallest_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 3, 3), ("b", 4, 4)], "k string, v int, id int")
    assert [r.id for r in rows.keep_smallest_with_ties(df, ["k"], "v").orderBy("id").collect()] == [1, 2, 4]


def test_not_in(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    ids = spark.createDataFrame([(1,)], "i int")
    assert rows_of(joins.not_in_ids(df, "k", ids, "i")) == [(2,)]
    assert rows_of(joins.not_in_ids(df, "k", ids.union(spark.createDataFrame([(None,)], "i int")), "i")) == []
    assert len(rows_of(joins.not_in_ids(df, "k", ids.where("i > 5"), "i"))) == 3


def test_reconcile_counts_null_keys(spark):
    a, b = spark.createDataFrame([(1,), (None,), (1,)], "k int"), spark.createDataFrame([(2,), (None,)], "k int")
    assert rows_of(reconcile.reconcile(a, b, ["k"])) == [(1, 2, 0, "left only"), (2, 0, 1, "right only"), (None, 1, 1, "both")]


# -- nested -------------------------------------------------------------------

def test_unpack_instructions_corners(spark):
    data = [
        (1, 1, [("old", '{"action":"X"}')]),
        (1, 2, [("p", '{"action":"REMOVE"}'), ("q", '{"action":"REPLACE","alternativeproducts":[{"externalid":"z","more":1},{"externalid":"y"}]}'), ("r", None)]),
        (2, 1, []), (3, 1, None),
    ]
    df = spark.createDataFrame(data, "o int, t int, products array<struct<external_id: string, strategy: string>>")
    got = nested.unpack_instructions(df, "o", ["t"], "products", "strategy").select("external_id", "action", "alternatives")
    assert rows_of(got) == [("p", "REMOVE", []), ("q", "REPLACE", ["z", "y"]), ("r", None, [])]


def test_promoted(spark):
    df = spark.createDataFrame([([-1], ["A"]), ([-1, 5], ["A"]), ([5], ["B"]), ([5], []), (None, ["A"])], "ids array<int>, types array<string>")
    assert [bool(r[0]) for r in df.select(nested.promoted("ids", "types", ["A"])).collect()] == [False, True, False, False, False]


# -- columns ------------------------------------------------------------------

def test_column_helpers(spark):
    df = spark.createDataFrame([(True, 0.0, 1.0), (False, 2.0, 1.0), (None, None, 1.0)], "f boolean, d double, n double")
    assert [tuple(r) for r in df.select(C.known_alive("f"), C.not_known_deleted("f"), C.safe_ratio("n", "d")).collect()] == [
        (False, False, None), (True, True, 0.5), (False, True, None)]
    bins = spark.createDataFrame([(0.0,), (0.2,), (0.21,), (1.0,), (1.5,), (None,)], "v double")
    labels = [r[0] for r in bins.select(C.fixed_bins("v", [0.0, 0.2, 1.0], ["low", "high"], "none")).collect()]
    assert labels == ["low", "low", "high", "high", "none", "none"]


def test_seconds_between_counts_whole_seconds(spark):
    df = spark.createDataFrame([(at(milliseconds=900), at(seconds=1, milliseconds=100))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(C.seconds_between("a", "b")).first()[0] == 0


def test_previous_full_week():
    assert spine.previous_full_week(date(2024, 6, 3)) == (date(2024, 5, 27), date(2024, 6, 2))
    assert spine.previous_full_week(date(2024, 6, 9)) == (date(2024, 5, 27), date(2024, 6, 2))


# -- statistics ---------------------------------------------------------------

@pytest.mark.parametrize("t,df,p", [(2.0, 10, 0.07338803), (1.0, 1, 0.5), (0.0, 5, 1.0), (2.776445, 4, 0.05), (1.96, 1e6, 0.0499962), (12.7062, 1, 0.05), (40.0, 30, 0.0)])
def test_student_t(t, df, p):
    assert abs(D.student_t_two_sided_value(t, df) - p) < 1e-6


def test_tails(spark):
    df = spark.createDataFrame([(1.959963985, 3.841458821), (-0.5, 0.0), (None, None)], "z double, x double")
    got = df.select(D.normal_two_sided("z"), D.normal_cdf("z"), D.chi_square_upper("x", F.lit(1.0))).collect()
    assert [round(v, 6) for v in got[0]] == [0.05, 0.975, 0.05]
    assert round(got[1][1], 6) == 0.308538 and got[1][2] == 1.0
    assert tuple(got[2]) == (None, None, None)


def test_single_row_group_has_no_verdict(spark):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("g", "b", None), ("h", "a", 1.0)], "g string, v string, x double")
    got = {r.g: r for r in inference.two_sample(df, ["g"], "x", "v", "a", "b").collect()}
    assert got["g"].delta_percent == 100.0 and got["g"].p_value is None and got["g"].is_significant is None
    assert got["h"].mean_variant is None and got["h"].p_value is None


def test_false_positive_rate_of_drawn_normals(spark):
    draws = spark.range(40 * 200).selectExpr("id % 40 as draw", "if(id % 80 < 40, 'a', 'b') as v").withColumn("x", F.randn(7))
    tests = inference.two_sample(draws, ["draw"], "x", "v", "a", "b")
    got = inference.false_positive_rate(tests, 0.05).first()
    assert got.n_tests == 40 and got.false_positive_rate < 0.25


def test_split_search_prefers_matching_split(spark):
    days = spark.range(30).selectExpr("id as d")
    df = days.join(spark.range(12).selectExpr("id as store"), F.lit(True)).selectExpr("store", "date_add(date'2024-01-01', cast(d as int)) as day", "100 + store + (d * 7) % 5 as m")
    got = splits.split_search(df, "store", "day", ["m"], 6, 0.5, F.col("day") < F.lit(date(2024, 1, 25)))
    assert got.where("is_best").count() == 1 and got.count() == 6


def test_hash_assignment_is_stable_and_even(spark):
    df = splits.assign_by_hash(spark.range(20000), "id", "s", [(500, "a"), (1000, "b")])
    n = df.where("variant = 'a'").count()
    assert 9700 < n < 10300
    again = splits.assign_by_hash(spark.range(20000), "id", "s", [(500, "a"), (1000, "b")])
    assert df.exceptAll(again).isEmpty()


def test_counterfactual_finds_the_step(spark):
    df = spark.range(20).selectExpr("date_add(date'2024-01-01', cast(id as int)) as day", "id * 1.0D as control", "2 * id + 1 + if(id >= 15, 10, 0) as treat")
    cut = F.lit(date(2024, 1, 16))
    got = splits.counterfactual_effect(df, [], "day", F.col("day") < cut, F.col("day") >= cut).orderBy("day").collect()
    assert [round(r.effect, 6) for r in got] == [10.0] * 5 and round(got[-1].cumulative_effect, 6) == 50.0


def test_not_available(spark):
    data = [
        (False, 2, True, True, 1, 2, 1, True), (False, 2, True, True, 1, 1, 1, True), (False, 2, True, True, 1, 1, 0, True),
        (False, 2, True, True, 1, 1, 2, False), (False, 2, False, True, 1, 2, 1, False), (False, 0, True, True, 1, 2, 1, False),
        (True, 0, False, False, 1, None, None, True), (None, 2, True, True, 1, None, None, False),
    ]
    df = spark.createDataFrame(data, "c boolean, q int, d boolean, r boolean, p int, np int, nq int, want boolean")
    flag = basket.not_available(*[F.col(x) for x in ("c", "q", "d", "r", "p", "np", "nq")])
    assert [r[0] == r[1] for r in df.select(flag, "want").collect()] == [True] * len(data)


# -- sources ------------------------------------------------------------------

def test_dated_files(spark, tmp_path):
    for day, text in (("2024-01-05", "a,b\n1,x\n"), ("2024-01-06", "a,b\n2,y\n3,z\n")):
        (tmp_path / f"on_off_{day}.csv").write_text(text)
    got = tables.read_dated_files(spark, f"{tmp_path}/*.csv", "a int, b string")
    assert rows_of(got) == [(1, "x", date(2024, 1, 5)), (2, "y", date(2024, 1, 6)), (3, "z", date(2024, 1, 6))]


def test_cached_result_builds_once(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert tables.cached_result(spark, f"{tmp_path}/out", build).count() == 3
    assert len(calls) == 1


def test_scan_reads_only_what_is_needed(spark, small):
    df = spine.within_days(tables.scan_table(spark, small, "orders", ["o_orderkey", "o_orderdate"]), "o_orderdate", date(1997, 1, 1), date(1997, 1, 31))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "o_totalprice" not in plan


def test_t_tail_with_many_degrees_of_freedom():
    from statistics import NormalDist

    from cohorta.functions.distributions import student_t_two_sided_value

    for df in (1e5, 1e6, 1.0001e6, 1e9, 1e13):
        z = student_t_two_sided_value(1.96, df)
        normal = 2 * NormalDist().cdf(-1.96)
        assert abs(z - normal - 1.96 * (1 + 1.96**2) / (2 * df) * NormalDist().pdf(1.96)) < 1e-9


def test_all_variants_are_compared(spark):
    rows = [(v, float(i % 5 + k)) for k, v in enumerate("abc") for i in range(20)]
    df = spark.createDataFrame(rows, "variant string, m double")
    one = inference.ab_test_metrics(df, [], ["m"], "variant", "a", ["b", "c"])
    every = inference.ab_test_metrics(df, [], ["m"], "variant", "a", ["b", "c"], compare_all=True)
    assert {(r.baseline, r.treatment) for r in every.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    p = {(r.baseline, r.treatment): r.p_value for r in one.collect()}
    for r in every.collect():
        if (r.baseline, r.treatment) in p and r.p_value < 1:
            assert abs(r.p_value / 3 - p[r.baseline, r.treatment] / 2) < 1e-9


def test_exposed_customers_without_observations_are_kept(spark):
    import datetime as d

    e = spark.createDataFrame([(1, d.date(2024, 1, 2)), (2, d.date(2024, 1, 9)), (3, d.date(2024, 1, 3))], "c long, exposed date")
    o = spark.createDataFrame([(1, d.date(2024, 1, 5), 2), (3, d.date(2024, 1, 1), 1)], "c long, day date, n long")
    got = basket.cumulative_observations(o, e, "c", "day", "exposed", F.lit(d.date(2024, 1, 1)), ["n"])
    assert sorted((r.c, r.exposure_week, r.week, r.n) for r in got.collect()) == [(1, 1, 1, 2.0), (2, 2, None, 0.0)]
