"""The test tables' ``events`` as retail events.

That table has no product, category or place, so they follow from the columns it has. The
same mapping is written in SQL in :mod:`basketflow.plans.oracles`.
"""

from pyspark.sql import DataFrame

from basketflow.schema import ADD_TO_CART

# --- fixed values: the retail vocabulary ---------------------------------------
CATEGORIES = ["Tech", "Home", "Toys", "Clothes", "Books"]
CITIES = ["Guayaquil", "Quito", "Cuenca", "Manta"]
PROVINCES = ["Guayas", "Pichincha", "Azuay", "Manabí"]


def _pick(names: list[str], index: str) -> str:
    listed = ", ".join(f"'{name}'" for name in names)
    return f"get(array({listed}), cast({index} AS int))"


def retail_view(events: DataFrame) -> DataFrame:
    """Batch or streaming ``events`` -> the columns of ``EVENT_SCHEMA``."""
    province = "if(user_id % 4 < 3, user_id % 4, event_id % 4)"
    # ``k`` gets a step of its own, so that the JSON is read once for its two uses.
    return events.selectExpr(
        "*", "try_cast(get_json_object(props, '$.k') AS int) AS k"
    ).selectExpr(
        "try_cast(user_id AS int) AS user_id",
        "k AS product_id",
        f"{_pick(CATEGORIES, 'k % 5')} AS category",
        f"if(event_type = 'click', '{ADD_TO_CART}', event_type) AS event_type",
        "value AS price",
        "cast(ts AS timestamp) AS timestamp",
        "format_string('ST%03d', event_id % 99 + 1) AS store_id",
        "if(event_id % 2 = 0, 'physical_store', 'online_store') AS store_type",
        f"{_pick(CITIES, 'user_id % 4')} AS city",
        f"{_pick(PROVINCES, province)} AS province",
        "named_struct('lat', cast(event_id % 181 - 90 AS double),"
        " 'lon', cast(event_id % 361 - 180 AS double)) AS location",
    )
