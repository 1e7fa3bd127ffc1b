"""Live metrics. Each takes typed events, batch or streaming, and returns a frame.

All aggregates combine map-side, so a minute, user or product that holds a large share of
the rows reaches the shuffle as one row per input partition.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.functions import (
    cents,
    exact_mean,
    exact_sum,
    is_kind,
    percent,
    reads,
    tally,
    tumbling,
)
from basketflow.schema import ADD_TO_CART, PURCHASE, VIEW


@reads("event_type", "price", "timestamp")
def sales_per_minute(
    events: DataFrame, width: str = "1 minute", ordered: bool = True
) -> DataFrame:
    """Purchases per time bucket: sum, number and mean of prices, newest first.

    ``ordered=False`` leaves out the sort, which streams allow in complete mode only.
    """
    sales = (
        tumbling(events.where(is_kind(PURCHASE)), width)
        .agg(
            exact_sum("price").alias("total_sales"),
            F.count("*").alias("total_transactions"),
            cents(exact_mean("price")).alias("avg_transaction"),
        )
        .selectExpr(
            "span.start AS minute", "total_sales", "total_transactions", "avg_transaction"
        )
    )
    return sales.orderBy(F.desc("minute")) if ordered else sales


@reads("event_type", "product_id", "category")
def top_viewed_products(events: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most viewed products; equal counts go by product and category."""
    return (
        events.where(is_kind(VIEW))
        .groupBy("product_id", "category")
        .agg(F.count("*").alias("view_count"))
        .orderBy(F.desc("view_count"), "product_id", "category")
        .limit(n)
    )


@reads("event_type", "user_id", "price")
def average_ticket_per_user(events: DataFrame, ordered: bool = True) -> DataFrame:
    """Mean, sum and number of each user's purchases, biggest spender first.

    ``ordered=False`` leaves out the sort.
    """
    tickets = (
        events.where(is_kind(PURCHASE))
        .groupBy("user_id")
        .agg(
            cents(exact_mean("price")).alias("avg_ticket"),
            cents(exact_sum("price")).alias("total_spent"),
            F.count("*").alias("purchase_count"),
        )
    )
    return tickets.orderBy(F.desc("total_spent"), "user_id") if ordered else tickets


@reads("event_type", "timestamp")
def conversion_rate(
    events: DataFrame, width: str = "1 minute", ordered: bool = True
) -> DataFrame:
    """Views, carts and purchases per time bucket and their ratios in percent.

    Ratios of counts, not of users, so they may exceed 100. A bucket with none of the
    three kinds still gives a row of zeros.
    """
    rates = (
        tumbling(events, width)
        .agg(
            tally(VIEW).alias("views"),
            tally(ADD_TO_CART).alias("carts"),
            tally(PURCHASE).alias("purchases"),
        )
        .select(
            F.col("span.start").alias("minute"),
            "views",
            "carts",
            "purchases",
            percent("carts", "views").alias("view_to_cart_rate"),
            percent("purchases", "carts").alias("cart_to_purchase_rate"),
            percent("purchases", "views").alias("overall_conversion"),
        )
    )
    return rates.orderBy(F.desc("minute")) if ordered else rates


@reads("event_type", "category", "timestamp")
def visits_by_category(
    events: DataFrame, width: str = "1 minute", time_col: str = "timestamp"
) -> DataFrame:
    """Views, carts and purchases per time bucket and category.

    ``timestamp`` carries no watermark, which ties a stream to complete mode;
    ``time_col="event_time"`` makes append mode possible.
    """
    shopping = events.where(is_kind(VIEW, ADD_TO_CART, PURCHASE))
    return (
        tumbling(shopping, width, "category", on=time_col)
        .agg(
            tally(VIEW).alias("views"),
            tally(ADD_TO_CART).alias("add_to_cart"),
            tally(PURCHASE).alias("purchases"),
        )
        .selectExpr(
            "span.start AS window_start", "span.end AS window_end", "category",
            "views", "add_to_cart", "purchases",
        )
    )


@reads("category", "city", "timestamp")
def demand_peaks(
    events: DataFrame, width: str = "1 minute", threshold: int = 10
) -> DataFrame:
    """Time bucket, category and city with more than ``threshold`` events of any kind."""
    return (
        tumbling(events, width, "category", "city")
        .agg(F.count("*").alias("event_count"))
        .where(F.col("event_count") > threshold)
        .selectExpr("span.start AS peak_time", "category", "city", "event_count")
    )
