from basketflow.operators.metrics import (
    average_ticket_per_user,
    conversion_rate,
    demand_peaks,
    sales_per_minute,
    top_viewed_products,
    visits_by_category,
)
from basketflow.operators.reports import (
    latest_category_activity,
    sales_series,
    top_products,
    user_behaviour,
)
from basketflow.operators.rollups import (
    aggregate_by_category,
    aggregate_by_product,
    aggregate_by_user,
    coarsen,
)

__all__ = [
    "aggregate_by_category", "aggregate_by_product", "aggregate_by_user",
    "average_ticket_per_user", "coarsen", "conversion_rate", "demand_peaks",
    "latest_category_activity", "sales_per_minute", "sales_series", "top_products",
    "top_viewed_products", "user_behaviour", "visits_by_category",
]
