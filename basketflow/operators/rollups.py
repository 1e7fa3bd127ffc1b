"""Windowed roll-ups kept as tables: activity and money per user, category, product.

A roll-up is made in two steps: mergeable columns (counts, the exact sum of what was paid in
parts, the price range) and the public columns that follow from them. With ``parts=True`` the
mergeable columns are kept beside the public ones; :func:`coarsen` then derives hours from five
minutes, or days from hours, exactly as if the events had been aggregated anew.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.functions import (
    cents,
    is_kind,
    merged_parts,
    money_parts,
    parts_mean,
    parts_sum,
    reads,
    tally,
    tumbling,
)
from basketflow.schema import ADD_TO_CART, PURCHASE, VIEW

#: Keys of each stored roll-up and the names of its sum and mean.
_TABLES = {
    "users": (["user_id"], "total_spent", "avg_ticket"),
    "categories": (["category"], "total_revenue", "avg_price"),
    "products": (["product_id", "category"], "total_revenue", "avg_price"),
}
_COUNTS = ["total_views", "total_carts", "total_purchases"]
_PARTS = ["paid_units", "paid_millionths", "paid_others", "paid_count"]
_RANGE = ["highest", "lowest"]


def _public(merged: DataFrame, table: str, parts: bool) -> DataFrame:
    """``span``, keys and mergeable columns -> the columns of the stored table."""
    keys, total, mean = _TABLES[table]
    columns: dict[str, Column] = {name: F.col(name) for name in [*keys, *_COUNTS]}
    columns[total] = cents(parts_sum("paid"))
    columns[mean] = cents(parts_mean("paid", "paid_count"))
    kept = _PARTS
    if table == "products":
        columns |= {"max_price": cents("highest"), "min_price": cents("lowest")}
        kept = _PARTS + _RANGE
    return merged.select(
        F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
        *[value.alias(name) for name, value in columns.items()], *(kept if parts else []),
    )


def _rollup(events: DataFrame, width: str, table: str, parts: bool) -> DataFrame:
    """Counts of the three kinds and takings per time bucket and keys.

    In the sum of purchase prices other events weigh 0; the mean goes over priced purchases
    alone. It divides that same sum, so one set of partial sums serves both.
    """
    keys, _, _ = _TABLES[table]
    purchased = is_kind(PURCHASE)
    columns = {
        "total_views": tally(VIEW),
        "total_carts": tally(ADD_TO_CART),
        "total_purchases": tally(PURCHASE),
    } | money_parts("weighed", "paid")
    columns["paid_count"] = F.expr(f"count_if({purchased} AND price IS NOT NULL)")
    if table == "products":
        columns |= {"highest": F.max("price"), "lowest": F.min("price")}
    # Weighed before the aggregation, so that its many uses there read a column.
    weighed = events.withColumn("weighed", F.expr(f"if({purchased}, price, 0D)"))
    merged = tumbling(weighed, width, *keys).agg(*[v.alias(n) for n, v in columns.items()])
    return _public(merged, table, parts)


def coarsen(rollup: DataFrame, table: str, width: str, parts: bool = False) -> DataFrame:
    """A stored roll-up, read with its parts, over wider time buckets.

    ``width`` must be a multiple of the stored one: a stored window that lies across the bounds
    of a bucket is an error. Equal to aggregating the events of the stored windows directly.
    """
    keys, _, _ = _TABLES[table]
    summed = [*_COUNTS, "paid_count"]
    columns = {name: F.sum(name) for name in summed} | merged_parts("paid")
    if table == "products":
        columns |= {"highest": F.max("highest"), "lowest": F.min("lowest")}
    columns["reach"] = F.max("window_end")
    merged = tumbling(rollup, width, *keys, on="window_start").agg(
        *[v.alias(n) for n, v in columns.items()]
    )
    across = F.raise_error(F.lit(f"a stored window lies across the bounds of {width}"))
    fits = F.when(F.col("reach") > F.col("span.end"), across).otherwise(F.col("total_views"))
    return _public(merged.withColumn("total_views", fits), table, parts)


@reads("event_type", "user_id", "price", "timestamp")
def aggregate_by_user(
    events: DataFrame, width: str = "5 minutes", parts: bool = False
) -> DataFrame:
    """Roll-up per user."""
    return _rollup(events, width, "users", parts)


@reads("event_type", "category", "price", "timestamp")
def aggregate_by_category(
    events: DataFrame, width: str = "5 minutes", parts: bool = False
) -> DataFrame:
    """Roll-up per category."""
    return _rollup(events, width, "categories", parts)


@reads("event_type", "product_id", "category", "price", "timestamp")
def aggregate_by_product(
    events: DataFrame, width: str = "5 minutes", parts: bool = False
) -> DataFrame:
    """Roll-up per product and category, with the price range over events of every kind."""
    return _rollup(events, width, "products", parts)
