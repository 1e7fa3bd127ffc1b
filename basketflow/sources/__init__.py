from basketflow.sources.codec import encode_events, parse_events, with_event_time
from basketflow.sources.files import (
    compacted_days,
    read_events_files,
    read_newest_day,
    read_result,
    read_table,
    stored_days,
    time_column,
    with_day,
)
from basketflow.sources.kafka import kafka_options, read_events_kafka

__all__ = [
    "compacted_days", "encode_events", "kafka_options", "parse_events", "read_events_files",
    "read_events_kafka", "read_newest_day", "read_result", "read_table", "stored_days",
    "time_column", "with_day", "with_event_time",
]
