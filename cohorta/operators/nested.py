"""Arrays, nested rows and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.operators.rows import latest_per_key

ALTERNATIVES = "array<struct<externalid: string>>"


def unpack_products(events: DataFrame, order: str, event_order: Sequence[str], products: str) -> DataFrame:
    """Last event per order, one row per product, with the product's fields as columns."""
    last = latest_per_key(events, [order], event_order)
    others = [c for c in last.columns if c != products]
    return last.select(*others, F.inline(products))


def unpack_instructions(events: DataFrame, order: str, event_order: Sequence[str], products: str, strategy: str) -> DataFrame:
    """Products of the last event per order, with the action and the ids of the
    alternatives taken out of the strategy JSON. The list is transformed in place, so
    no regrouping is needed; a missing list gives an empty one."""
    rows = unpack_products(events, order, event_order, products)
    alternatives = F.from_json(F.get_json_object(strategy, "$.alternativeproducts"), ALTERNATIVES)
    ids = F.transform(alternatives, lambda a: a["externalid"])
    return (
        rows.withColumn("action", F.get_json_object(strategy, "$.action"))
        .withColumn("alternatives", F.coalesce(ids, F.array().cast("array<string>")))
        .drop(strategy)
    )


def explode_list_count(df: DataFrame, keys: Sequence[str], text: str, separator: str = ",", name: str = "n_items") -> DataFrame:
    """Distinct items of separated lists per key."""
    items = df.select(*keys, F.explode(F.split(text, separator)).alias("_item"))
    return items.select(*keys, F.trim("_item").alias("_item")).groupBy(*keys).agg(F.countDistinct("_item").alias(name))


def promoted(ids: str, types: str, wanted: Sequence[str], none_id: int = -1) -> Column:
    """True for a row with a real promotion of a wanted type: ids known and not just
    the placeholder."""
    only_none = (F.size(ids) == 1) & F.array_contains(ids, none_id)
    any_type = F.exists(types, lambda t: t.isin(list(wanted)))
    return F.col(ids).isNotNull() & ~only_none & any_type
