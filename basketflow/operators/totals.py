"""Running totals from partial results, in place of state that never shrinks.

Views per product, tickets per user and visits per category have no watermark: as complete-mode
streams they keep every key for ever. Here each batch of events gives a partial result of its
own; partial results add up, so the total at any time is their sum, late events included.
"""

from collections.abc import Callable
from dataclasses import dataclass

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


@dataclass(frozen=True)
class Total:
    """A result that is kept as mergeable rows.

    ``partial`` makes such rows from events; ``merge`` gives the aggregates that add up rows of
    equal ``keys``; ``finish`` makes the public result from rows that are added up.
    """

    name: str
    keys: tuple[str, ...]
    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[], dict[str, Column]]
    finish: Callable[[DataFrame], DataFrame]

    def merged(self, rows: DataFrame) -> DataFrame:
        """Partial rows added up: one row for each key, again a partial result."""
        aggregates = [value.alias(name) for name, value in self.merge().items()]
        return rows.groupBy(*self.keys).agg(*aggregates)

    def result(self, rows: DataFrame) -> DataFrame:
        return self.finish(self.merged(rows))


def views_per_product(n: int = 5) -> Total:
    """The rows behind ``top_viewed_products``."""
    keys = ("product_id", "category")

    @reads("event_type", "product_id", "category")
    def partial(events: DataFrame) -> DataFrame:
        return events.where(is_kind(VIEW)).groupBy(*keys).agg(F.count("*").alias("view_count"))

    return Total(
        "views_per_product", keys, partial,
        lambda: {"view_count": F.sum("view_count")},
        lambda rows: rows.orderBy(F.desc("view_count"), *keys).limit(n),
    )


def ticket_per_user(ordered: bool = True) -> Total:
    """The rows behind ``average_ticket_per_user``: exact sums, which means need."""

    @reads("event_type", "user_id", "price")
    def partial(events: DataFrame) -> DataFrame:
        columns = money_parts("price", "paid") | {
            "paid_count": F.count("price"), "purchase_count": F.count("*")
        }
        return events.where(is_kind(PURCHASE)).groupBy("user_id").agg(
            *[value.alias(name) for name, value in columns.items()]
        )

    def finish(rows: DataFrame) -> DataFrame:
        tickets = rows.select(
            "user_id", cents(parts_mean("paid", "paid_count")).alias("avg_ticket"),
            cents(parts_sum("paid")).alias("total_spent"), "purchase_count",
        )
        return tickets.orderBy(F.desc("total_spent"), "user_id") if ordered else tickets

    return Total(
        "ticket_per_user", ("user_id",), partial,
        lambda: merged_parts("paid") | {n: F.sum(n) for n in ("paid_count", "purchase_count")},
        finish,
    )


def visits_per_category(width: str = "1 minute") -> Total:
    """The rows behind ``visits_by_category``."""
    kinds = {"views": VIEW, "add_to_cart": ADD_TO_CART, "purchases": PURCHASE}

    @reads("event_type", "category", "timestamp")
    def partial(events: DataFrame) -> DataFrame:
        counts = [tally(kind).alias(name) for name, kind in kinds.items()]
        shopping = events.where(is_kind(*kinds.values()))
        return tumbling(shopping, width, "category", on="timestamp").agg(*counts).selectExpr(
            "span.start AS window_start", "span.end AS window_end", "category", *kinds
        )

    return Total(
        "visits_per_category", ("window_start", "window_end", "category"), partial,
        lambda: {name: F.sum(name) for name in kinds},
        lambda rows: rows,
    )
