"""Batch reports over the stored result tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sales_series(sales: DataFrame) -> DataFrame:
    """Sales over time, oldest first."""
    return sales.select("minute", "total_sales").orderBy("minute")


def latest_category_activity(categories: DataFrame) -> DataFrame:
    """Activity per category in the newest window of the table.

    The newest start is a scalar subquery over one column. Over a stored table its value
    becomes a pushed-down filter of the second scan, which then skips older row groups.
    """
    newest = categories.select(F.max("window_start")).scalar()
    return categories.where(F.col("window_start") == newest).select(
        "category", "total_views", "total_carts", "total_purchases"
    )


def user_behaviour(users: DataFrame) -> DataFrame:
    """One point per window and user."""
    return users.select("user_id", "total_views", "total_purchases", "total_carts")


def top_products(products: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most viewed products over all windows; rows without a key do not count."""
    keys = ["product_id", "category"]
    return (
        products.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.sum("total_views").alias("total_views"))
        .orderBy(F.desc("total_views"), *keys)
        .limit(n)
    )
