"""Stored tables laid out by day: pruning, the newest day, compaction of closed days."""

import os
import re
import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from basketflow import operators as op
from basketflow.sources import (
    compacted_days, parse_events, read_events_files, read_newest_day, read_result, read_table, stored_days, with_day,
)
from basketflow.streaming import closed_days, compact, start_parquet
from tests.conftest import event, rows

FIRST = date(2025, 1, 1)


def on_day(day, clock="00:00:00", **fields):
    made = event(clock, **fields)
    made["timestamp"] += timedelta(days=day)
    return made


@pytest.fixture
def by_day(spark, make_events, tmp_path):
    """Five days of categories, laid out by day and flat."""
    events = make_events(
        *[
            on_day(day, f"{hour:02d}:00:00", category=f"c{n}")
            for day in range(5) for hour in range(0, 24, 6) for n in range(day + 1)
        ]
    )
    table = op.aggregate_by_category(events)
    with_day(table, "categories").write.partitionBy("day").parquet(str(tmp_path / "t"))
    table.write.parquet(str(tmp_path / "flat"))
    return str(tmp_path / "t"), str(tmp_path / "flat")


def scans(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)


def paths_read(frame):
    return {r[0] for r in frame.select(F.input_file_name()).distinct().collect()}


def files_read(frame):
    return {re.search(r"day=[\d-]+", f).group() for f in paths_read(frame)}


def test_days_come_from_the_listing(spark, by_day):
    path, flat = by_day
    assert stored_days(spark, path) == [FIRST + timedelta(days=n) for n in range(5)]
    assert stored_days(spark, flat) == stored_days(spark, f"{path}/missing") == []
    assert "day" in read_table(spark, path, "categories").columns


def test_range_of_days_prunes_partitions(spark, by_day):
    path, flat = by_day
    since, until = FIRST + timedelta(days=1), FIRST + timedelta(days=2)
    some = read_result(spark, path, "categories", since=since, until=until)
    assert some.columns == read_result(spark, path, "categories").columns
    (found,) = scans(some)
    assert "day" in found[0] and "2025-01-02" in found[0] and "GreaterThanOrEqual(window_start" in found[1]
    assert files_read(some) == {"day=2025-01-02", "day=2025-01-03"}
    assert rows(some) == rows(read_result(spark, flat, "categories", since=since, until=until))
    assert some.count() == 4 * (2 + 3)
    assert read_result(spark, path, "categories", until=until).count() == 4 * 6
    assert read_result(spark, path, "categories", since=until).count() == 4 * 12


def test_newest_window_reads_one_partition(spark, by_day):
    path, flat = by_day
    newest = op.latest_category_activity(read_newest_day(spark, path, "categories"))
    assert files_read(newest) == {"day=2025-01-05"}
    assert all("2025-01-05" in filters for filters, _ in scans(newest))
    assert len(scans(newest)) >= 1
    assert rows(newest) == rows(op.latest_category_activity(read_result(spark, flat, "categories")))
    assert rows(newest) == rows(op.latest_category_activity(read_newest_day(spark, flat, "categories")))
    assert newest.count() == 5


def test_newest_day_without_rows_is_passed_over(spark, by_day):
    path, _ = by_day
    os.makedirs(f"{path}/day=2025-02-01")
    found = read_newest_day(spark, path, "categories")
    assert files_read(found) == {"day=2025-01-05"}


def test_missing_and_empty_tables(spark, tmp_path):
    (tmp_path / "bare").mkdir()
    for name in ("bare", "missing"):
        assert read_newest_day(spark, str(tmp_path / name), "users").isEmpty()
        assert read_result(spark, str(tmp_path / name), "users", since=FIRST).isEmpty()
        assert compact(spark, str(tmp_path / name), "users") == []


def run_stream(spark, folder, tmp_path, partition_by=("day",)):
    raw = read_events_files(spark, folder, max_files=1)
    result = op.aggregate_by_category(parse_events(raw), parts=True)
    result = with_day(result, "categories") if partition_by else result
    query = start_parquet(
        result, str(tmp_path / "t"), str(tmp_path / "c"), "days", partition_by=partition_by, once=True
    )
    query.awaitTermination()
    return str(tmp_path / "t")


def days_of(first, last):
    return [
        [on_day(day, f"{hour:02d}:{minute:02d}:00", category=f"c{n}") for n in range(3)]
        for day in range(first, last) for hour in range(0, 24, 8) for minute in (0, 30)
    ]


def test_compaction_keeps_the_rows_and_bounds_the_files(spark, drop_files, tmp_path):
    path = run_stream(spark, drop_files(*days_of(0, 4)), tmp_path)
    before = rows(read_result(spark, path, "categories", parts=True))
    many = [len([f for f in os.listdir(f"{path}/day=2025-01-0{d}") if f.endswith(".parquet")]) for d in (1, 2, 3)]
    assert min(many) >= 6
    earlier = read_result(spark, path, "categories", parts=True)
    assert closed_days(spark, path, "categories") == [FIRST + timedelta(days=n) for n in range(3)]
    assert compact(spark, path, "categories") == [FIRST + timedelta(days=n) for n in range(3)]
    after = read_result(spark, path, "categories", parts=True)
    assert rows(after) == before == rows(earlier)
    assert sorted(compacted_days(spark, path)) == [FIRST + timedelta(days=n) for n in range(3)]
    assert compact(spark, path, "categories") == []
    packed = [f for f in paths_read(after) if "_compacted" in f]
    assert len(packed) == 3
    one = read_result(spark, path, "categories", since=FIRST, until=FIRST)
    assert one.count() == 18 and all("_compacted" in f for f in paths_read(one))
    assert rows(op.latest_category_activity(read_newest_day(spark, path, "categories"))) == rows(
        op.latest_category_activity(after)
    )

    # The stream goes on, on the same checkpoint; the next days are packed beside the first.
    run_stream(spark, drop_files(*days_of(4, 6)), tmp_path)
    whole = rows(read_result(spark, path, "categories"))
    assert compact(spark, path, "categories") == [FIRST + timedelta(days=n) for n in (3, 4)]
    assert rows(read_result(spark, path, "categories")) == whole
    events = parse_events(read_events_files(spark, str(tmp_path / "incoming"), streaming=False))
    closed = op.aggregate_by_category(events).where("window_end <= timestamp'2025-01-06 16:28:00'")
    assert whole == rows(closed)


def test_large_day_gets_several_files(spark, by_day):
    path, _ = by_day
    before = rows(read_result(spark, path, "categories"))
    compact(spark, path, "categories", target_bytes=1000)
    packed = [f for f in paths_read(read_result(spark, path, "categories")) if "_compacted" in f]
    assert len(packed) > 4
    assert rows(read_result(spark, path, "categories")) == before


def test_readers_while_days_are_packed(spark, by_day):
    path, _ = by_day
    before = rows(read_result(spark, path, "categories"))
    found, done = [], threading.Event()

    def read():
        while not done.is_set():
            found.append(rows(read_result(spark, path, "categories")))

    reader = threading.Thread(target=read)
    reader.start()
    compact(spark, path, "categories")
    done.set()
    reader.join()
    assert found and all(f == before for f in found)


def test_compaction_that_fails_changes_nothing(spark, by_day, monkeypatch):
    from basketflow.streaming import compaction

    path, _ = by_day
    before = rows(read_result(spark, path, "categories"))
    monkeypatch.setattr(compaction.folders, "replace_text", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        compact(spark, path, "categories")
    monkeypatch.undo()
    assert compacted_days(spark, path) == {} and rows(read_result(spark, path, "categories")) == before
    assert len(compact(spark, path, "categories")) == 4
    assert rows(read_result(spark, path, "categories")) == before


def test_flat_streamed_tables_are_refused(spark, drop_files, tmp_path):
    path = run_stream(spark, drop_files(*days_of(0, 2)), tmp_path, partition_by=())
    with pytest.raises(ValueError, match="laid out flat"):
        compact(spark, path, "categories")


def test_parts_of_a_table_written_without_them_are_null(spark, by_day):
    path, _ = by_day
    assert read_result(spark, path, "categories", parts=True).where("paid_count IS NOT NULL").isEmpty()


def test_all_tables_of_a_base_path(spark, drop_files, tmp_path):
    from basketflow.compact import compact_tables
    from basketflow.plans.application import Settings, start

    folder = drop_files(*days_of(0, 3))
    for query in start(spark, Settings(str(tmp_path / "base")), read_events_files(spark, folder), once=True):
        query.awaitTermination()
    wanted = {t: rows(read_result(spark, f"{tmp_path}/base/{t}", t)) for t in ("users", "categories", "products")}
    packed = compact_tables(spark, f"{tmp_path}/base/")
    # No purchases, so no sales; that table has no day yet.
    assert packed == {t: [FIRST, FIRST + timedelta(days=1)] for t in ("users", "categories", "products")}
    assert wanted == {t: rows(read_result(spark, f"{tmp_path}/base/{t}", t)) for t in wanted}
