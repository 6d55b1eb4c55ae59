"""One key holds a third of all rows: the chunked route gives the same results."""

import pytest
from pyspark.sql import functions as F

from cohorta.operators import activity, exposure, funnel, joins, ranks, scans
from cohorta.plans.base import open_end
from cohorta.session import tune

LIMIT = 90


def same(a, b):
    columns = a.columns
    b = b.select(*columns)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def events(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    user = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 50 == 1, None).otherwise(F.col("user_id"))
    return e.withColumn("user_id", user.cast("long")).withColumn("day", F.to_date("ts"))


@pytest.fixture(scope="module")
def known(events):
    """Null keys included: they take the place of known users nowhere."""
    return events


@pytest.fixture(scope="module")
def windows(known):
    e = known.where("event_type = 'signup'").withColumn("variant", F.when(F.col("event_id") % 2 == 0, "a").otherwise("b"))
    return e.select("user_id", "event_id", "variant", "ts")


@pytest.mark.parametrize("keys", [["user_id"], [], ["user_id", "event_type"]])
def test_all_scans(events, keys):
    e = events.withColumn("v", F.when(F.col("event_type") == "view", F.col("value").cast("decimal(12,2)")))
    todo = {
        "a": scans.next_value("v"), "b": scans.previous_value("v"), "c": scans.next_known("v"), "d": scans.last_known("v"),
        "e": scans.upcoming("v"), "f": scans.running_sum("v"), "g": scans.seen("event_type"),
    }
    sort = lambda df: df.withColumn("g", F.array_sort("g"))
    plain = scans.ordered_scans(e, keys, ["ts", "event_id"], todo)
    chunked = scans.ordered_scans(e, keys, ["ts", "event_id"], todo, group_limit=30)
    same(sort(plain), sort(chunked))


def test_chunks_are_bounded(events):
    hot = scans.hot_groups(events, ["user_id"], LIMIT)
    assert hot.groups >= 1 and hot.rows >= events.count() / 3


def test_coarse_measurement_skips_fine_one(events):
    assert scans.hot_groups(events, ["user_id", "event_type"], 10**6, coarse=["user_id"]).groups == 0
    # A third of the rows over five event types: about 65 rows in each of the hot user's groups.
    assert scans.hot_groups(events, ["user_id", "event_type"], 30, coarse=["user_id"]).groups > 0


def test_exposures(known, windows):
    build = lambda limit: exposure.exposure_windows(windows, ["user_id"], "ts", open_end(), ["event_id"], group_limit=limit)
    w = build(10**6)
    same(w, build(LIMIT))
    e = known.select("event_id", "user_id", "ts")
    for assign in (exposure.assign_variant, exposure.assign_variant_closed):
        for how in ("inner", "left"):
            same(assign(e, w, ["user_id"], "ts", how=how), assign(e, w, ["user_id"], "ts", how=how, group_limit=LIMIT))


def test_sessions_and_funnels(known):
    build = lambda limit: funnel.sessionize(known, "user_id", "ts", 6 * 3600, ["event_id"], group_limit=limit)
    s = build(10**6)
    same(s, build(LIMIT))
    steps = [(n, F.col("event_type") == n) for n in ("view", "click", "purchase")]
    rows = s.withColumn("side", F.col("event_id") % 2)
    for anchor in ("previous", "first"):
        for strict in (False, True):
            run = lambda limit: funnel.session_funnel(rows, ["user_id", "day"], "ts", steps, ["side"], anchor, strict, coarse=["user_id"], group_limit=limit)
            same(run(10**6), run(LIMIT // 3))
    run = lambda limit: funnel.conversion_within(
        s, F.col("event_type") == "view", F.col("event_type") == "purchase", ["user_id"], "ts", 36000, "session_id", ["day"], group_limit=limit
    )
    same(run(10**6), run(LIMIT))


def test_follow_ups(known):
    a, b = known.where("event_type = 'click'"), known.where("event_type = 'purchase'")
    run = lambda limit: funnel.next_within(a, b, ["user_id"], "ts", "ts", 86400, group_limit=limit)
    same(run(10**6), run(LIMIT))
    run = lambda limit: funnel.follow_up_counts(a, b, ["user_id"], "ts", [-1, 0, 3600, 86400], group_limit=limit)
    same(run(10**6), run(LIMIT))
    s = known.withColumn("session_id", F.concat_ws("-", "user_id", "day"))
    run = lambda limit: funnel.nearest_follow_up(
        s.where("event_type = 'error'").select("session_id", "user_id", "ts"), s.where("event_type = 'view'"),
        "user_id", "session_id", "ts", "ts", ["event_id"], 86400, group_limit=limit,
    )
    same(run(10**6), run(LIMIT))


def test_ranks(known):
    e = known.withColumn("value", F.floor("value").cast("double"))
    run = lambda limit: ranks.ranked(e, ["event_type"], "value", group_limit=limit).select("event_id", "rank_min", "rank_dense", "rank_avg", "rank_percent")
    same(run(10**6), run(5))
    points = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for group in ([], ["event_type"]):
        run = lambda limit: ranks.percentiles(e, group, "value", points, group_limit=limit).select(*group, *[F.round(p, 9).alias(p) for p in points])
        same(run(10**6), run(5))
        run = lambda limit: ranks.box_stats(e, group, "value", group_limit=limit)
        same(run(10**6), run(5))
    weights = e.groupBy("event_id").agg(F.sum("value").alias("w"))
    run = lambda limit: ranks.cumulative_share(weights, "event_id", "w", group_limit=limit).withColumn("cumulative_share", F.round("cumulative_share", 6))
    same(run(10**6), run(LIMIT))


def test_retention_and_versions(known):
    run = lambda limit: activity.retention(known, ["user_id"], ["ts", "event_id"], "day", 2, group_limit=limit)
    same(run(10**6), run(LIMIT))
    versions = (
        known.groupBy("user_id", F.col("day").alias("start_date")).agg(F.max("value").alias("top"))
        .withColumn("end_date", F.date_add("start_date", 2)).where(F.dayofmonth("start_date") % 4 == 0)
    )
    facts = known.select("event_id", "user_id", "day")
    run = lambda limit: joins.point_in_time_join(facts, versions, ["user_id"], "day", "start_date", "end_date", ["top"], group_limit=limit)
    same(run(10**6), run(LIMIT))


def test_equal_rows_of_one_key_are_cut(spark):
    """One key and day holds most rows: chunks stay bounded and the results equal."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), F.lit(1).alias("day"), F.col("id").alias("v"))
    chunks = scans._cut(df, ["k"], ["day"], 30).groupBy("_chunk").count()
    assert chunks.agg(F.max("count")).first()[0] < 300
    run = lambda limit: scans.ordered_scans(df, ["k"], ["day"], {"s": scans.running_sum("v")}, group_limit=limit).groupBy("k").agg(F.max("s"), F.count("*"))
    same(run(10**6), run(100))


def test_hot_chain_is_measured_once(spark, known, monkeypatch):
    calls = []
    real = funnel.hot_groups
    monkeypatch.setattr(funnel, "hot_groups", lambda *a, **k: calls.append(1) or real(*a, **k))
    monkeypatch.setattr(scans, "hot_groups", lambda *a, **k: calls.append(1) or real(*a, **k))
    steps = [(n, F.col("event_type") == n) for n in ("view", "click", "purchase", "error", "signup")]
    build = lambda limit: funnel.session_funnel(known, ["user_id"], "ts", steps, group_limit=limit)
    hot = build(LIMIT)
    assert len(calls) == 1
    same(build(10**6), hot)


@pytest.mark.parametrize("limit", [10**6, 20])
def test_group_without_values_keeps_its_row(spark, limit):
    rows = [("a", float(i) / 7) for i in range(60)] + [("b", None)] * 5 + [(None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q, r.m) for r in ranks.percentiles(df, ["g"], "v", {"q": 0.25, "m": 0.5}, group_limit=limit).collect()}
    plain = {r.g: tuple(r.p) if r.p else (None, None) for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5]).alias("p")).collect()}
    assert got == plain and got["b"] == (None, None)


def test_running_shares_do_not_depend_on_the_route(known):
    e = known.select("event_id", F.col("value").cast("double").alias("value")).where("value is not null")
    same(ranks.cumulative_share(e, "event_id", "value"), ranks.cumulative_share(e, "event_id", "value", group_limit=50))


def test_null_keys_meet_nothing(spark):
    import datetime as d

    t = lambda h: d.datetime(2024, 1, 1, h)
    e = spark.createDataFrame([(1, None, t(2)), (2, 7, t(2)), (3, None, t(3))], "event_id long, user_id long, ts timestamp_ntz")
    w = spark.createDataFrame([(None, t(1), t(9), "a"), (7, t(1), t(9), "b")], "user_id long, start_time timestamp_ntz, end_time timestamp_ntz, variant string")
    for assign in (exposure.assign_variant, exposure.assign_variant_closed):
        for limit in (10**6, 1):
            got = assign(e, w, ["user_id"], "ts", how="left", group_limit=limit)
            assert {r.event_id: r.variant for r in got.collect()} == {1: None, 2: "b", 3: None}
            assert [r.event_id for r in assign(e, w, ["user_id"], "ts", group_limit=limit).collect()] == [2]
    found = funnel.next_within(e, e.select("user_id", F.col("ts").alias("t2")), ["user_id"], "ts", "t2", group_limit=1)
    assert {r.event_id: r.followed_at for r in found.collect()} == {1: None, 2: t(2), 3: None}


def test_tune_bounds_what_a_task_reads(spark):
    """A stage of joins and aggregates takes several times its input in memory."""
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.minPartitionNum"]
    kept = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[0], "64MB")
        spark.conf.set(names[1], "1m")
        spark.conf.set(names[2], "1")
        tune(spark)
        assert spark.conf.get(names[1]) == "1m"  # smaller ones stay
        wide = spark.range(2_000_000).groupBy(F.xxhash64("id").alias("a")).agg(F.max(F.xxhash64("id", F.lit(1))).alias("b"))
        assert wide.rdd.getNumPartitions() > 1  # some 40 MB
    finally:
        for n, value in kept.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
        tune(spark)
