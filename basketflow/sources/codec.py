"""JSON text <-> typed events."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.schema import EVENT_SCHEMA, event_fields

# Keeps microseconds, which the default output format cuts off.
_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def with_event_time(events: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Add ``event_time``, the watermarked copy of ``timestamp``."""
    return events.withColumn("event_time", F.to_timestamp("timestamp")).withWatermark(
        "event_time", delay
    )


def parse_events(
    raw: DataFrame, delay: str = "2 minutes", fields: Iterable[str] | None = None
) -> DataFrame:
    """Typed, watermarked events from a frame with a JSON ``value`` (binary or string).

    Text that is no JSON object gives a row of nulls and a field of the wrong type gives a
    null in that field; no row is dropped. ``fields`` limits parsing to the named ones
    (``timestamp`` is always included).

    The struct is opened with ``inline`` and not with ``data.*``: filters are then applied
    to its columns, where otherwise the optimizer copies ``from_json`` into the filter and
    parses every text two or three times.
    """
    wanted = None if fields is None else {"timestamp", *fields}
    event = F.from_json(F.col("value").cast("string"), event_fields(wanted))
    return raw.select(F.inline(F.array(event))).transform(with_event_time, delay)


def encode_events(events: DataFrame) -> DataFrame:
    """One JSON text per event in ``value``; the inverse of :func:`parse_events`."""
    event = F.struct(*[n for n in EVENT_SCHEMA.names if n in events.columns])
    return events.select(
        F.to_json(event, {"timestampFormat": _TIMESTAMP_FORMAT}).alias("value")
    )
