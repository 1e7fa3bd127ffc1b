"""The catalog's queries in SQL (DuckDB), over views of the same tables.

Money is summed in whole cents and rounded by integer division, so that the expected
values do not depend on the rounding of doubles.
"""

from basketflow.plans.catalog import all_queries

_RETAIL = """
WITH retail AS (
  SELECT CAST(user_id AS INTEGER) AS user_id,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS product_id,
         (['Tech', 'Home', 'Toys', 'Clothes', 'Books'])
           [CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1] AS category,
         CASE event_type WHEN 'click' THEN 'add_to_cart' ELSE event_type END AS event_type,
         value AS price,
         CAST(round(value * 100) AS BIGINT) AS price_cents,
         ts AS "timestamp",
         'ST' || lpad(CAST(event_id % 99 + 1 AS VARCHAR), 3, '0') AS store_id,
         CASE WHEN event_id % 2 = 0 THEN 'physical_store' ELSE 'online_store' END AS store_type,
         (['Guayaquil', 'Quito', 'Cuenca', 'Manta'])[user_id % 4 + 1] AS city,
         (['Guayas', 'Pichincha', 'Azuay', 'Manabí'])
           [CASE WHEN user_id % 4 < 3 THEN user_id % 4 ELSE event_id % 4 END + 1] AS province,
         CAST(event_id % 181 - 90 AS DOUBLE) AS lat,
         CAST(event_id % 361 - 180 AS DOUBLE) AS lon
  FROM events)
"""


_RETAIL_IN_TIME = _RETAIL.replace(
    "FROM events)",
    """FROM events
  WHERE event_id % 10 <> 0
     OR floor((epoch_ms(ts) // 1000 - (SELECT min(epoch_ms(ts) // 1000) FROM events)) * 1000.0
          / (SELECT max(epoch_ms(ts) // 1000) - min(epoch_ms(ts) // 1000) FROM events)) >= 500
     OR time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes'
          > (SELECT max(ts) FROM events) - INTERVAL '2 minutes')
""",
)


def _count(kind: str) -> str:
    return f"count(*) FILTER (WHERE event_type = '{kind}')"


_VIEWS, _CARTS, _PURCHASES = _count("view"), _count("add_to_cart"), _count("purchase")
_CENTS = "CAST(sum(price_cents) AS BIGINT)"
_PAID_CENTS = (
    "CAST(sum(CASE WHEN event_type = 'purchase' THEN price_cents ELSE 0 END) AS BIGINT)"
)


def _bucket(width: str) -> str:
    return f"time_bucket(INTERVAL '{width}', \"timestamp\")"


def _mean(cents: str, n: str) -> str:
    return f"((2 * {cents} + {n}) // (2 * nullif({n}, 0))) / 100.0::DOUBLE"


def _percent(part: str, base: str) -> str:
    rate = f"((20000 * {part} + {base}) // (2 * nullif({base}, 0))) / 100.0::DOUBLE"
    return f"coalesce({rate}, 0.0::DOUBLE)"


def _closed(query: str, end: str, only: str = "true") -> str:
    """Rows whose window had closed when the stream ended."""
    newest = f'(SELECT max("timestamp") FROM retail WHERE {only})'
    return f"SELECT * FROM ({query}) WHERE {end} <= {newest} - INTERVAL '2 minutes'"


_SALES = f"""
SELECT {_bucket('1 minute')} AS minute, {_CENTS} / 100.0::DOUBLE AS total_sales,
       count(*) AS total_transactions, {_mean(_CENTS, 'count(*)')} AS avg_transaction
FROM retail WHERE event_type = 'purchase' GROUP BY 1
"""

_TOP_VIEWED = """
SELECT product_id, category, count(*) AS view_count
FROM retail WHERE event_type = 'view' GROUP BY ALL
ORDER BY view_count DESC, product_id, category LIMIT 5
"""

_TICKETS = f"""
SELECT user_id, {_mean(_CENTS, 'count(*)')} AS avg_ticket,
       {_CENTS} / 100.0::DOUBLE AS total_spent, count(*) AS purchase_count
FROM retail WHERE event_type = 'purchase' GROUP BY user_id
"""

_CONVERSION = f"""
SELECT minute, views, carts, purchases,
       {_percent('carts', 'views')} AS view_to_cart_rate,
       {_percent('purchases', 'carts')} AS cart_to_purchase_rate,
       {_percent('purchases', 'views')} AS overall_conversion
FROM (SELECT {_bucket('1 minute')} AS minute, {_VIEWS} AS views, {_CARTS} AS carts,
             {_PURCHASES} AS purchases
      FROM retail GROUP BY 1)
"""

_VISITS = f"""
SELECT {_bucket('1 minute')} AS window_start,
       {_bucket('1 minute')} + INTERVAL '1 minute' AS window_end, category,
       {_VIEWS} AS views, {_CARTS} AS add_to_cart, {_PURCHASES} AS purchases
FROM retail WHERE event_type IN ('view', 'add_to_cart', 'purchase') GROUP BY 1, 2, 3
"""

_PEAKS = f"""
SELECT {_bucket('1 day')} AS peak_time, category, city, count(*) AS event_count
FROM retail GROUP BY 1, 2, 3 HAVING count(*) > 10
"""


_PEAKS_PER_MINUTE = f"""
SELECT {_bucket('1 minute')} AS peak_time, category, city, count(*) AS event_count
FROM retail GROUP BY 1, 2, 3 HAVING count(*) > 1
"""


def _rollup(keys: str, total: str, mean: str, extra: str = "", width: str = "5 minutes") -> str:
    return f"""
SELECT {_bucket(width)} AS window_start,
       {_bucket(width)} + INTERVAL '{width}' AS window_end, {keys},
       {_VIEWS} AS total_views, {_CARTS} AS total_carts, {_PURCHASES} AS total_purchases,
       {_PAID_CENTS} / 100.0::DOUBLE AS {total}, {_mean(_PAID_CENTS, _PURCHASES)} AS {mean}
       {extra}
FROM retail GROUP BY ALL
"""


_BY_USER = _rollup("user_id", "total_spent", "avg_ticket")
_BY_CATEGORY = _rollup("category", "total_revenue", "avg_price")
_RANGE = (
    ", max(price_cents) / 100.0::DOUBLE AS max_price, min(price_cents) / 100.0::DOUBLE AS min_price"
)
_BY_PRODUCT = _rollup("product_id, category", "total_revenue", "avg_price", _RANGE)
_DAYS = _rollup("category", "total_revenue", "avg_price", width="1 day")
# Days made of the five minutes that had closed when the stream ended.
_CLOSED_DAYS = _DAYS.replace(
    "FROM retail",
    f"""FROM retail WHERE {_bucket('5 minutes')} + INTERVAL '5 minutes'
       <= (SELECT max("timestamp") FROM retail) - INTERVAL '2 minutes'""",
)
_TOP_PRODUCTS = """
SELECT product_id, category, CAST(sum(total_views) AS BIGINT) AS total_views
FROM ({}) WHERE product_id IS NOT NULL AND category IS NOT NULL
GROUP BY product_id, category ORDER BY total_views DESC, product_id, category LIMIT 10
"""

# Only purchases reach this query's watermark: its filter comes first.
_CLOSED_SALES = _closed(
    _SALES, "minute + INTERVAL '1 minute'", only="event_type = 'purchase'"
)

_BODIES = {
    "parse_events": """
        SELECT user_id, product_id, category, event_type, price, "timestamp", store_id,
               store_type, city, province, "timestamp" AS event_time, lat, lon
        FROM retail""",
    "sales_from_json": _SALES,
    "sales_per_minute": _SALES,
    "top_viewed_products": _TOP_VIEWED,
    "average_ticket_per_user": _TICKETS,
    "conversion_rate": _CONVERSION,
    "visits_by_category": _VISITS,
    "demand_peaks": _PEAKS,
    "demand_peaks_per_minute": _PEAKS_PER_MINUTE,
    "aggregate_by_user": _BY_USER,
    "aggregate_by_category": _BY_CATEGORY,
    "aggregate_by_product": _BY_PRODUCT,
    "sales_series": f"SELECT minute, total_sales FROM ({_SALES}) ORDER BY minute",
    "latest_category_activity": f"""
        SELECT category, total_views, total_carts, total_purchases FROM ({_BY_CATEGORY})
        WHERE window_start = (SELECT max({_bucket('5 minutes')}) FROM retail)""",
    "user_behaviour": f"""
        SELECT user_id, total_views, total_purchases, total_carts FROM ({_BY_USER})""",
    "top_products": f"""
        SELECT product_id, category, CAST(sum(total_views) AS BIGINT) AS total_views
        FROM ({_BY_PRODUCT}) WHERE product_id IS NOT NULL AND category IS NOT NULL
        GROUP BY product_id, category
        ORDER BY total_views DESC, product_id, category LIMIT 10""",
    "stream_sales_per_minute": _SALES,
    "stream_top_viewed_products": _TOP_VIEWED,
    "stream_average_ticket_per_user": _TICKETS,
    "stream_conversion_rate": _CONVERSION,
    "stream_visits_by_category": _VISITS,
    "stream_demand_peaks": _closed(_PEAKS, "peak_time + INTERVAL '1 day'"),
    "stream_aggregate_by_user": _closed(_BY_USER, "window_end"),
    "stream_aggregate_by_category": _closed(_BY_CATEGORY, "window_end"),
    "stream_aggregate_by_product": _closed(_BY_PRODUCT, "window_end"),
    "stream_visits_by_category_append": _closed(
        _VISITS, "window_end", only="event_type IN ('view', 'add_to_cart', 'purchase')"
    ),
    "stream_sales_table": _CLOSED_SALES,
    "stream_sales_from_json": _CLOSED_SALES,
    "stream_resumed_by_user": _closed(_BY_USER, "window_end"),
    "stream_resumed_by_product": _closed(_BY_PRODUCT, "window_end"),
    "hours_by_user": _rollup("user_id", "total_spent", "avg_ticket", width="1 hour"),
    "days_by_category": _DAYS,
    "hours_by_product": _rollup(
        "product_id, category", "total_revenue", "avg_price", _RANGE, width="1 hour"
    ),
    "stored_sales_series": f"SELECT minute, total_sales FROM ({_CLOSED_SALES}) ORDER BY minute",
    "stored_user_behaviour": f"""
        SELECT user_id, total_views, total_purchases, total_carts
        FROM ({_closed(_BY_USER, 'window_end')})""",
    "stored_top_products": _TOP_PRODUCTS.format(_closed(_BY_PRODUCT, "window_end")),
    "stored_days_by_category": _CLOSED_DAYS,
    "landed_by_user": _closed(_BY_USER, "window_end"),
    "landed_by_product": _closed(_BY_PRODUCT, "window_end"),
    "landed_demand_peaks": _closed(_PEAKS, "peak_time + INTERVAL '1 day'"),
    "landed_rejected": """
        SELECT CASE WHEN store_id LIKE '%3' THEN 'no JSON object' ELSE 'no readable time' END AS reason,
               count(*) AS records
        FROM retail WHERE store_id LIKE '%3' OR store_id LIKE '%7' GROUP BY 1""",
    "landing_account": """
        SELECT count(*) AS records, count(*) FILTER (WHERE store_id LIKE '%3') AS no_object,
               count(*) FILTER (WHERE store_id LIKE '%7') AS no_time
        FROM retail""",
    "application_products": _closed(_BY_PRODUCT, "window_end"),
    "application_users_with_landing": _closed(_BY_USER, "window_end"),
    "application_queries": """
        SELECT name, (SELECT count(*) FROM retail) AS input_rows
        FROM (SELECT unnest([
          'sales_per_minute', 'top_viewed_products', 'average_ticket_per_user', 'conversion_rate',
          'visits_by_category', 'demand_peaks', 'aggregate_by_user', 'aggregate_by_category',
          'aggregate_by_product', 'sales_table']) AS name)""",
    "running_top_viewed_products": _TOP_VIEWED,
    "running_average_ticket_per_user": _TICKETS,
    "running_visits_by_category": _VISITS,
}
_BODIES["binary_events"] = _BODIES["parse_events"]
_BODIES["latest_category_activity_by_day"] = _BODIES["latest_category_activity"]


def all_oracles() -> dict[str, str]:
    """SQL for every query of the catalog."""
    plain = {name: _RETAIL + body for name, body in _BODIES.items()}
    # Late rows come when the newest row of all has been seen: only open windows take them.
    found = plain | {"stream_late_by_category": _RETAIL_IN_TIME + _BODIES["stream_aggregate_by_category"]}
    return {name: found[name] for name in all_queries()}
