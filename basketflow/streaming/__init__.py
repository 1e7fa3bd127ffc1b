from basketflow.streaming.account import Account
from basketflow.streaming.compaction import closed_days, compact
from basketflow.streaming.guard import ChangedQuery, refuse_changes
from basketflow.streaming.landing import read_landed, read_rejected, start_landing, stream_landed
from basketflow.streaming.sinks import (
    hold_snapshot,
    read_snapshot,
    start_console,
    start_parquet,
    start_snapshot,
    write_events_kafka,
)
from basketflow.streaming.storage import refuse_lost_checkpoint, shared_root, workspace
from basketflow.streaming.totals import merge_totals, read_totals, start_totals

__all__ = [
    "Account", "ChangedQuery", "closed_days", "compact", "hold_snapshot", "merge_totals",
    "read_landed", "read_rejected", "read_snapshot", "read_totals", "refuse_changes",
    "refuse_lost_checkpoint", "shared_root", "start_console", "start_landing", "start_parquet",
    "start_snapshot", "start_totals", "stream_landed", "workspace", "write_events_kafka",
]
