"""Order, product and store metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohorta.functions.columns import case_map, safe_ratio
from cohorta.operators.aggregates import conditional_distinct
from cohorta.operators.reshape import unpivot_metrics


# -- availability of ordered products ---------------------------------------

def effective_quantity(quantity: Column, split_order: Column) -> Column:
    """Ordered quantity; an order split off another one counts as 0."""
    return F.when(split_order, F.lit(0)).otherwise(quantity)


def not_available(
    complaint: Column, quantity: Column, delivered: Column, replaced: Column,
    product: Column, new_product: Column, new_quantity: Column,
) -> Column:
    """A product line was not available: the customer complained, or in a delivered
    order the line was replaced by another product, cut down, or taken out."""
    changed = (quantity > 0) & replaced & delivered
    other_product = new_product != product
    cut_down = (new_quantity < quantity) & (new_quantity > 0)
    taken_out = (new_quantity == 0) & (new_product == product)
    return F.coalesce(complaint, F.lit(False)) | F.coalesce(changed & (other_product | cut_down | taken_out), F.lit(False))


def availability_metrics(lines: DataFrame, by: Sequence[str], line: str, order: str) -> DataFrame:
    """Per group: products and orders with something not available, placed products,
    quantity and value. ``lines`` has flags ``missing``, ``order_missing``, ``delivered``,
    ``is_original`` and ``was_replaced`` beside ``quantity`` and ``line_value``.

    Lines shrink to one row per line, then per order, so every count is a plain one.
    """
    per_line = lines.groupBy(*by, order, line).agg(
        F.max("missing").alias("missing"),
        F.max("order_missing").alias("order_missing"),
        F.max("delivered").alias("delivered"),
        F.max("was_replaced").alias("was_replaced"),
        F.max(F.when(F.col("is_original"), F.col("quantity"))).alias("quantity"),
        F.max(F.when(F.col("is_original"), F.col("line_value"))).alias("line_value"),
    )
    per_order = per_line.groupBy(*by, order).agg(
        F.count_if("missing").alias("missing_lines"),
        F.max(F.col("missing") | F.col("order_missing")).alias("order_missing"),
        F.max("delivered").alias("delivered"),
        F.count_if(~F.col("was_replaced")).alias("placed"),
        F.sum("quantity").alias("quantity"),
        F.sum("line_value").alias("line_value"),
    )
    return per_order.groupBy(*by).agg(
        F.sum("missing_lines").alias("products_not_available"),
        F.count_if("order_missing").alias("orders_not_available"),
        F.sum("placed").alias("products_placed"),
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if("delivered").alias("n_delivered"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity_placed"),
        F.coalesce(F.sum("line_value"), F.lit(0.0)).alias("value_placed"),
    )


def gmv_loss(orders: DataFrame, outliers: DataFrame, order: str, by: Sequence[str], signed: Sequence[str], absolute: Sequence[str], original: str) -> DataFrame:
    """Lost share of the original value per group, leaving out orders that hold a price
    outlier. ``signed`` deltas are summed as they are; ``absolute`` ones are summed and
    their absolute value taken off."""
    kept = orders.join(outliers.select(order).distinct(), order, "left_anti")
    zero = F.lit(0.0)
    parts = {c: F.sum(F.coalesce(F.col(c), zero)) for c in signed}
    parts |= {c: F.abs(F.sum(F.coalesce(F.col(c), zero))) for c in absolute}
    sums = kept.groupBy(*by).agg(
        *[e.alias(f"sum_{c}") for c, e in parts.items()],
        F.sum(F.coalesce(F.col(original), zero)).alias("gmv_loss_denominator"),
    )
    loss = zero
    for c in signed:
        loss = loss + F.col(f"sum_{c}")
    for c in absolute:
        loss = loss - F.col(f"sum_{c}")
    return sums.withColumn("gmv_loss_numerator", loss).withColumn(
        "gmv_loss_share", safe_ratio("gmv_loss_numerator", "gmv_loss_denominator")
    )


# -- categories and stores ---------------------------------------------------

def orders_with_category(orders: DataFrame, lines: DataFrame, order: str, in_category: Column) -> DataFrame:
    """Orders that hold at least one line of a category."""
    return orders.join(lines.where(in_category).select(order).distinct(), order, "left_semi")


def orders_without_category(orders: DataFrame, lines: DataFrame, order: str, in_category: Column) -> DataFrame:
    """Orders that hold no line of it."""
    return orders.join(lines.where(in_category).select(order).distinct(), order, "left_anti")


def category_penetration(lines: DataFrame, by: Sequence[str], order: str, in_category: Column) -> DataFrame:
    """Orders with a category over all orders, per group."""
    counts = conditional_distinct(lines, by, order, {"n_orders": F.lit(True), "n_category_orders": in_category})
    return counts.withColumn("penetration", safe_ratio("n_category_orders", "n_orders"))


def category_mix(lines: DataFrame, group: str, category: str, categories: Sequence[str], weight: Column) -> DataFrame:
    """Each category's share of its group's summed weight, one column per category."""
    total = F.sum(weight)
    share = lambda c: F.coalesce(safe_ratio(F.sum(F.when(F.col(category) == c, weight)), total), F.lit(0.0))
    return lines.groupBy(group).agg(total.alias("volume"), *[share(c).alias(c) for c in categories])


def segment_stores(stores: DataFrame, rules, default: str | None = None) -> DataFrame:
    """Rule-based segment; the first matching rule wins."""
    return stores.withColumn("segment", case_map(rules, default))


def migration_share(stores: DataFrame, inventory: DataFrame, store: str, by: Sequence[str]) -> DataFrame:
    """Stores with an inventory row over all stores."""
    migrated = inventory.select(store).distinct().withColumn("_in", F.lit(True))
    joined = stores.join(migrated, store, "left")
    counts = conditional_distinct(joined, by, store, {"n_stores": F.lit(True), "n_migrated": F.col("_in")})
    return counts.withColumn("migrated_share", safe_ratio("n_migrated", "n_stores"))


def units_and_value_per_order(lines: DataFrame, by: Sequence[str], order: str, units: str, value: str, special: Column) -> DataFrame:
    """Units and value per order, for all orders, those with a special line, and the rest."""
    per_order = lines.groupBy(*by, order).agg(
        F.max(F.coalesce(special, F.lit(False))).alias("_s"), F.sum(units).alias("_u"), F.sum(value).alias("_v")
    )
    out = []
    for name, cond in (("all", F.lit(True)), ("special", F.col("_s")), ("other", ~F.col("_s"))):
        n = F.count_if(cond)
        out += [
            n.alias(f"n_orders_{name}"),
            safe_ratio(F.sum(F.when(cond, F.col("_u"))), n).alias(f"units_per_order_{name}"),
            safe_ratio(F.sum(F.when(cond, F.col("_v"))), n).alias(f"value_per_order_{name}"),
        ]
    return per_order.groupBy(*by).agg(*out)


def share_of_parent(parts: DataFrame, parent: Sequence[str], part: Sequence[str], unit: str) -> DataFrame:
    """Distinct units of each part over distinct units of its parent (a partner's
    sessions over its city's, per day)."""
    once = parts.select(*parent, *part, unit).distinct()
    whole = once.groupBy(*parent).agg(F.countDistinct(unit).alias("n_parent"))
    each = once.groupBy(*parent, *part).agg(F.count(unit).alias("n_part"))
    return each.join(whole, list(parent)).withColumn("share", safe_ratio("n_part", "n_parent"))


def event_time_alignment(daily: DataFrame, starts: DataFrame, unit: str, day: str, start: str, reach: int) -> DataFrame:
    """Day offset to the unit's own start, kept within +/- ``reach`` days and labelled,
    with the number of days the unit has on either side."""
    aligned = daily.join(starts, unit).withColumn("day_offset", F.datediff(F.col(day), F.col(start)))
    aligned = aligned.where(F.col("day_offset").between(-reach, reach))
    label = F.when(F.col("day_offset") > 0, "after").when(F.col("day_offset") < 0, "before").otherwise("start")
    sizes = aligned.groupBy(unit).agg(
        F.count_if(F.col("day_offset") < 0).alias("n_pre"), F.count_if(F.col("day_offset") > 0).alias("n_post")
    )
    return aligned.withColumn("period", label).join(sizes, unit)


def first_enabled_day(versions: DataFrame, unit: str, enabled: Column, start: str) -> DataFrame:
    """First day a flag is on, over all versions of a unit."""
    return versions.where(enabled).groupBy(unit).agg(F.min(F.to_date(start)).alias("first_enabled_day"))


def switchback_compare(daily: DataFrame, config: DataFrame, unit: str, day: str, by: str, ratios: dict[str, tuple[str, str]], totals: Sequence[str]) -> DataFrame:
    """Daily on/off configuration joined by unit and day; totals and ratios per group and
    configuration, side by side. Totals change by percent of configuration 1; ratios (in
    percent) change by points and by percent of configuration 0."""
    joined = daily.join(config, [unit, day])
    needed = sorted({c for pair in ratios.values() for c in pair} | set(totals))
    side = lambda c, k: F.sum(F.when(F.col("config") == k, F.col(c)))
    sums = joined.groupBy(by).agg(*[side(c, k).alias(f"{c}_{k}") for c in needed for k in (0, 1)])
    out = [F.col(by)]
    for c in totals:
        out += [F.col(f"{c}_0").alias(f"{c}_config_0"), F.col(f"{c}_1").alias(f"{c}_config_1")]
        out.append((100 * safe_ratio(F.col(f"{c}_0") - F.col(f"{c}_1"), F.col(f"{c}_1"))).alias(f"{c}_change_percent"))
    for name, (n, d) in ratios.items():
        r0, r1 = 100 * safe_ratio(f"{n}_0", f"{d}_0"), 100 * safe_ratio(f"{n}_1", f"{d}_1")
        out += [r0.alias(f"{name}_config_0"), r1.alias(f"{name}_config_1"), (r0 - r1).alias(f"{name}_change_points")]
        out.append((100 * safe_ratio(r0 - r1, r0)).alias(f"{name}_change_percent"))
    return sums.select(*out)


def metrics_per_unit(units: DataFrame, unit: str, sources: dict[str, DataFrame]) -> DataFrame:
    """Every unit with the metrics of all sources, 0 where a source lacks it. Sources
    are one row per unit."""
    out = units
    for source in sources.values():
        names = [c for c in source.columns if c != unit]
        out = out.join(source, unit, "left").fillna(0, names)
    return out


def stitch(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Aggregates on the same keys side by side; the first table says which keys there are."""
    out = tables[0]
    for table in tables[1:]:
        right = table.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        match = F.lit(True)
        for k in keys:
            match = match & out[k].eqNullSafe(right[f"_r_{k}"])
        out = out.join(right, match, "left").drop(*[f"_r_{k}" for k in keys])
    return out


def customer_distribution(orders: DataFrame, customer: str) -> DataFrame:
    """Customers per number of orders, with frequency and running share in percent."""
    per_customer = orders.groupBy(customer).agg(F.count(F.lit(1)).alias("n_orders"))
    table = per_customer.groupBy("n_orders").agg(F.count(F.lit(1)).alias("n_customers"))
    # One row per number of orders: k different numbers take at least k(k-1)/2 orders.
    everyone = Window.partitionBy(F.lit(0))
    total, so_far = F.sum("n_customers").over(everyone), F.sum("n_customers").over(everyone.orderBy("n_orders"))
    return table.withColumn("frequency_percent", 100 * safe_ratio("n_customers", total)).withColumn(
        "cumulative_percent", 100 * safe_ratio(so_far, total)
    )


def cumulative_observations(observations: DataFrame, exposures: DataFrame, customer: str, day: str, exposed: str, start: Column, metrics: Sequence[str]) -> DataFrame:
    """Per exposed customer and week since ``start``, each metric's running total over the
    days after the exposure. Zero observations are left out (a week shows up only if
    something happened in it); metrics keep separate totals, so a metric silent in a week
    shows 0 there. An exposed customer without any observation has one row, with a null
    week and zeros; one observed only up to the exposure has none.
    """
    week = lambda c: (F.floor(F.datediff(F.col(c), start) / 7) + 1).cast("long")
    joined = observations.join(exposures, customer).where(F.col(day) > F.col(exposed))
    long = unpivot_metrics(joined, [customer, day, exposed], metrics).where(F.col("value") != 0)
    long = long.withColumn("exposure_week", week(exposed)).withColumn("week", week(day))
    keys = [customer, exposed, "exposure_week"]
    weekly = long.groupBy(*keys, "metric", "week").agg(F.sum("value").alias("value"))
    # One row per customer, metric and week: groups are as long as the test runs.
    so_far = Window.partitionBy(*keys, "metric").orderBy("week")
    running = weekly.withColumn("value", F.sum("value").over(so_far))
    found = running.groupBy(*keys, "week").agg(
        *[F.sum(F.when(F.col("metric") == m, F.col("value")).otherwise(0.0)).alias(m) for m in metrics]
    )
    silent = exposures.select(customer, exposed).where(F.col(customer).isNotNull()).distinct()
    silent = silent.join(observations.select(customer).distinct(), customer, "left_anti").withColumn("exposure_week", week(exposed))
    nothing = [F.lit(None).cast("long").alias("week"), *[F.lit(0.0).alias(m) for m in metrics]]
    return found.unionByName(silent.select(*keys, *nothing))
