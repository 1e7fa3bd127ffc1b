"""Event-kind predicates, counts, rates and time buckets."""

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F


def is_kind(*kinds: str) -> str:
    """SQL predicate: the event is of one of ``kinds``."""
    escaped = [kind.replace("\\", "\\\\").replace("'", "\\'") for kind in kinds]
    listed = ", ".join(f"'{kind}'" for kind in escaped)
    return f"event_type IN ({listed})"


def tally(kind: str) -> Column:
    """Number of events of one kind in the group, 0 when there are none."""
    return F.expr(f"count_if({is_kind(kind)})")


def percent(part: str, base: str) -> Column:
    """Column ``part`` in percent of ``base`` to two decimals, 0.0 when there is no base."""
    return F.expr(f"round(coalesce(try_divide({part} * 100D, {base}), 0D), 2)")


def tumbling(events: DataFrame, width: str, *keys: str, on: str = "event_time") -> GroupedData:
    """Group by a half-open, epoch-aligned time bucket named ``span`` and ``keys``."""
    return events.groupBy(F.window(on, width).alias("span"), *keys)


def reads(*names: str):
    """Note on an operator which event fields it needs.

    The streaming application parses only these from the JSON text.
    """

    def mark(operator):
        operator.fields = names
        return operator

    return mark
