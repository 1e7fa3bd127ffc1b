"""Event and result-table schemas."""

from pyspark.sql import types as T

# --- fixed values: the event wire format -------------------------------------
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("product_id", T.IntegerType()),
        T.StructField("category", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("store_type", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField(
            "location",
            T.StructType(
                [T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
            ),
        ),
    ]
)

VIEW = "view"
ADD_TO_CART = "add_to_cart"
PURCHASE = "purchase"

# --- fixed values: stored result tables --------------------------------------
# Name of the directory under the base path -> columns (DDL).
TABLE_SCHEMAS = {
    "sales_per_minute": (
        "minute timestamp, total_sales double, total_transactions bigint,"
        " avg_transaction double"
    ),
    "users": (
        "window_start timestamp, window_end timestamp, user_id int,"
        " total_views bigint, total_carts bigint, total_purchases bigint,"
        " total_spent double, avg_ticket double"
    ),
    "categories": (
        "window_start timestamp, window_end timestamp, category string,"
        " total_views bigint, total_carts bigint, total_purchases bigint,"
        " total_revenue double, avg_price double"
    ),
    "products": (
        "window_start timestamp, window_end timestamp, product_id int, category string,"
        " total_views bigint, total_carts bigint, total_purchases bigint,"
        " total_revenue double, avg_price double, max_price double, min_price double"
    ),
}

# --- fixed values: what the stored roll-ups hold beside their public columns ----
# The exact sum of what was paid in three parts, the number of priced purchases, and, for
# products, the price range before rounding. From these, coarser roll-ups follow exactly.
_PAID = "paid_units bigint, paid_millionths bigint, paid_others double, paid_count bigint"
PART_SCHEMAS = {
    "users": _PAID,
    "categories": _PAID,
    "products": f"{_PAID}, highest double, lowest double",
}

#: Partition column of tables that are laid out by day.
DAY = "day"


def table_schema(table: str, parts: bool = False) -> T.StructType:
    """The columns of a stored table, on demand with those of :data:`PART_SCHEMAS`."""
    public = T.StructType.fromDDL(TABLE_SCHEMAS[table])
    if not parts:
        return public
    if table not in PART_SCHEMAS:
        raise ValueError(f"table {table} holds no parts")
    return T.StructType(public.fields + T.StructType.fromDDL(PART_SCHEMAS[table]).fields)


def event_fields(names=None) -> T.StructType:
    """The part of the event schema that holds ``names``, in schema order."""
    if names is None:
        return EVENT_SCHEMA
    unknown = set(names) - set(EVENT_SCHEMA.names)
    if unknown:
        raise ValueError(f"not event fields: {sorted(unknown)}")
    return T.StructType([f for f in EVENT_SCHEMA if f.name in set(names)])
