"""Distinct counts that can be added up: exact bitmaps per day and dimension.

``count(distinct)`` over a week needs the week's rows again, as a customer of two days counts
once. Here ids get dense numbers once; a day's ids are then bits in blocks of 32,768, and any
period's distinct count is the number of bits in the blocks' union. The bitmaps hold at most one row
per day, dimension and block, however many events there were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.operators.scans import GROUP_LIMIT, ordered_scans, running_sum

NUMBER = "id_number"


def number_ids(ids: DataFrame, id: str, known: DataFrame | None = None, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per known id with its number, from 0 on without gaps. Ids in ``known`` (an earlier
    result) keep theirs and new ones follow, so earlier bitmaps stay right. No task numbers all ids:
    beyond ``group_limit`` they are counted in chunks."""
    new = ids.select(id).where(F.col(id).isNotNull()).distinct()
    first = 0
    if known is not None:
        new = new.join(known, id, "left_anti")
        last = known.agg(F.max(NUMBER)).first()[0]
        first = 0 if last is None else last + 1
    counted = ordered_scans(new.withColumn("_one", F.lit(1).cast("long")), [], [id], {"_upto": running_sum("_one")}, group_limit=group_limit)
    numbered = counted.select(id, (F.col("_upto") - 1 + F.lit(first)).cast("long").alias(NUMBER))
    return numbered if known is None else known.select(id, NUMBER).unionByName(numbered)


def daily_bitmaps(df: DataFrame, numbers: DataFrame, id: str, by: Sequence[str]) -> DataFrame:
    """Per group of ``by`` (a day and its dimensions) and block: the ids seen, as a bitmap. Rows
    with an unknown id count nowhere."""
    rows = df.select(id, *by).join(numbers, id)
    bucket, place = F.bitmap_bucket_number(NUMBER), F.bitmap_bit_position(NUMBER)
    return rows.groupBy(*by, bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bitmap"))


def distinct_in(bitmaps: DataFrame, by: Sequence[str], name: str = "n_distinct") -> DataFrame:
    """Distinct ids per group of ``by``, from the bitmaps alone; narrow them to a period first."""
    blocks = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("_n"))
    return blocks.groupBy(*by).agg(F.sum("_n").alias(name))
