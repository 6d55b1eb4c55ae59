"""Joins beyond the plain equi join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.functions.columns import all_of
from cohorta.operators.scans import GROUP_LIMIT, last_known, ordered_scans


def in_ids(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose key is among the ids. Repeated ids are dropped before they are shuffled:
    the right side of a semi join is never cut up, so one id must not come in bulk."""
    known = ids.select(F.col(id_col).alias("_id")).distinct()
    return df.join(known, df[key] == known["_id"], "left_semi")


def not_in_ids(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """SQL ``NOT IN``: nothing is left if an id is null, and a null key only passes
    an empty id list.

    Written as an anti join with those two cases as scalar checks, because Spark's
    own null-aware anti join works only with a broadcast id list.
    """
    facts = ids.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(id_col).isNull()).alias("nulls"))
    n, nulls = facts.select("n").scalar(), facts.select("nulls").scalar()
    known = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct()
    kept = df.join(known, df[key] == known["_id"], "left_anti")
    return kept.where((n == 0) | ((nulls == 0) & F.col(key).isNotNull()))


def left_join_if_in(df: DataFrame, right: DataFrame, on: Sequence[str], key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Left join to the right rows whose key is among the ids. The right side is
    filtered first, so left rows survive whatever the filter removes. Matches come from
    an inner join, either side of which may be cut up where one key is hot; left rows
    without a match are added."""
    kept = in_ids(right, key, ids, id_col)
    alone = df.join(kept.select(*on).distinct(), list(on), "left_anti")
    return df.join(kept, list(on)).unionByName(alone, allowMissingColumns=True)


def either_key_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_key: str, first_key: str, second_key: str) -> DataFrame:
    """Match ``left_key`` with either of two right keys, together with common columns.

    Two equi joins instead of an OR over all pairs of a session; a right row with
    both keys equal is matched once.
    """
    same = [left[c] == right[c] for c in on]
    keep = [left[c] for c in left.columns] + [right[c] for c in right.columns if c not in on]
    by_first = left.join(right, all_of(same + [left[left_key] == right[first_key]])).select(*keep)
    new_match = ~left[left_key].eqNullSafe(right[first_key])
    by_second = left.join(right, all_of(same + [left[left_key] == right[second_key], new_match])).select(*keep)
    return by_first.unionByName(by_second)


def either_key_within(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_key: str, first_key: str, second_key: str,
    left_time: str, right_time: str, seconds: int,
) -> DataFrame:
    """As ``either_key_join``, for right rows at most ``seconds`` after the left one. Keys
    and time buckets are all part of the join key."""
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    pairs = []
    for key in (first_key, second_key):
        keyed = right.withColumn("_key", F.col(key))
        pairs.append(interval_join(left.withColumn("_key", F.col(left_key)), keyed, [*on, "_key"], left_time, right_time, seconds).select(*columns))
    return pairs[0].unionByName(pairs[1].where(~F.col(left_key).eqNullSafe(F.col(first_key))))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """All pairs with equal keys and ``left_time <= right_time <= left_time + seconds``.

    Time is cut into buckets as long as the interval and the bucket is part of the
    join key, so a row meets only rows of two neighbouring buckets, never its whole
    key. The right frame must not share column names with the left one, other than keys.
    """
    width = seconds * 1_000_000
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width).cast("long")
    a = left.withColumn("_b", bucket(left_time)).withColumn("_b", F.explode(F.array("_b", F.col("_b") + 1)))
    b = right.withColumn("_b", bucket(right_time))
    limit = F.col(left_time) + F.expr(f"interval {int(seconds)} seconds")
    pairs = a.join(b, [*keys, "_b"])
    return pairs.where(F.col(right_time).between(F.col(left_time), limit)).drop("_b")


def point_in_time_join(
    facts: DataFrame, versions: DataFrame, keys: Sequence[str], day: str, start: str, end: str, take: Sequence[str],
    *, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Version valid on the fact's day: from ``start`` up to the day before ``end``, open
    when ``end`` is null. Facts without a version stay, with nulls.

    Versions of one key do not overlap, so the last one begun by that day is the only
    candidate; it is found in one time-ordered scan of facts and versions together.
    """
    v = versions.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_kind"), F.struct(start, end, *take).alias("_version"))
    f = facts.withColumn("_t", F.col(day)).withColumn("_kind", F.lit(1))
    both = f.unionByName(v, allowMissingColumns=True)
    probe = facts.select(*keys).unionByName(versions.select(*keys))
    seen = ordered_scans(both, keys, ["_t", "_kind", "_version"], {"_v": last_known("_version")}, group_limit=group_limit, probe=probe, match_nulls=False)
    last_day = F.coalesce(F.date_sub(F.col(f"_v.{end}"), 1), F.lit("9999-12-31").cast("date"))
    valid = F.col(day) <= last_day
    fields = [F.when(valid, F.col(f"_v.{c}")).alias(c) for c in (start, end, *take)]
    return seen.where("_kind = 1").select(*facts.columns, *fields)


def replacement_join(lines: DataFrame, line_id: str, replaced_by: str, fields: Sequence[str]) -> DataFrame:
    """Every line with the fields of the line that replaced it, as ``new_<field>``. Lines
    that were not replaced, as a rule most, are spread by their own id."""
    newer = lines.select(F.col(line_id).alias("_new_id"), *[F.col(f).alias(f"new_{f}") for f in fields])
    match = (F.coalesce(lines[replaced_by], lines[line_id]) == newer["_new_id"]) & lines[replaced_by].isNotNull()
    return lines.join(newer, match, "left").drop("_new_id")


def category_from_maps(events: DataFrame, first_map: DataFrame, first_on: Sequence[str], second_map: DataFrame, second_on: Sequence[str], category: str) -> DataFrame:
    """Category of each event from the first map that knows it. Both maps are made
    distinct on their keys' rows beforehand, so an event is repeated only where a
    map really holds two categories for one key."""
    one = first_map.select(*first_on, F.col(category).alias("_c1")).distinct()
    two = second_map.select(*second_on, F.col(category).alias("_c2")).distinct()
    joined = events.join(one, list(first_on), "left").join(two, list(second_on), "left")
    return joined.withColumn(category, F.coalesce("_c1", "_c2")).drop("_c1", "_c2")
