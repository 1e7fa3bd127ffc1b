"""Snapshot versions: a pointer, retention, leases of readers."""

import os
import time

import pytest

from basketflow import folders, operators as op, versions
from basketflow.sources import parse_events, read_events_files
from basketflow.streaming import hold_snapshot, read_snapshot, start_snapshot
from tests.conftest import event, rows


def version_folders(root):
    return sorted(n for n in os.listdir(root) if n.startswith("batch="))


def write(spark, root, number, n, keep=2):
    version = versions.new_version(number)
    spark.range(n).write.parquet(f"{root}/{version}")
    versions.publish(spark, root, version, keep)
    return version


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "t")


def test_old_versions_go_and_the_newest_is_read(spark, root):
    schema = spark.range(0).schema
    for number in range(50):
        write(spark, root, number, number)
        assert len(version_folders(root)) <= 2
        assert read_snapshot(spark, root, schema).count() == number


def test_all_versions_can_be_kept(spark, root):
    for number in range(4):
        write(spark, root, number, 1, keep=None)
    assert len(version_folders(root)) == 4


def test_held_version_outlives_newer_ones(spark, root):
    schema = spark.range(0).schema
    write(spark, root, 0, 3)
    with hold_snapshot(spark, root, schema) as frame:
        for number in range(1, 6):
            write(spark, root, number, 10)
        assert frame.count() == 3
        assert len(version_folders(root)) == 3
    write(spark, root, 6, 10)
    assert len(version_folders(root)) == 2
    assert folders.names(spark, f"{root}/_leases") == []


def test_forgotten_lease_expires(spark, root):
    first = write(spark, root, 0, 1)
    lease = f"{root}/_leases/{first}~gone"
    os.makedirs(lease)
    past = time.time() - 100_000
    os.utime(lease, (past, past))
    for number in (1, 2):
        write(spark, root, number, 1)
    assert first not in version_folders(root)


def test_failed_attempt_is_never_read_and_removed(spark, root):
    first = write(spark, root, 0, 3)
    torn = f"{root}/{versions.new_version(1)}"
    os.makedirs(torn)
    assert versions.current(spark, root) == first
    again = write(spark, root, 1, 4)
    assert version_folders(root) == [first, again]


def test_repeated_batch_does_not_touch_what_is_read(spark, root):
    schema = spark.range(0).schema
    write(spark, root, 5, 3)
    frame = read_snapshot(spark, root, schema)
    write(spark, root, 5, 4)
    assert frame.count() == 3 and read_snapshot(spark, root, schema).count() == 4


def test_nothing_written_yet(spark, root):
    schema = spark.range(0).schema
    assert read_snapshot(spark, root, schema).isEmpty()
    with hold_snapshot(spark, root, schema) as frame:
        assert frame.isEmpty()


def test_disk_is_bounded_over_fifty_triggers(spark, drop_files, tmp_path, root):
    """One file, and so one trigger, at a time; the result equals the batch's."""
    folder = drop_files(*[[event(f"00:{n:02d}:00", user=n % 7)] for n in range(50)])
    events = parse_events(read_events_files(spark, folder, max_files=1))
    result = op.visits_by_category(events)
    query = start_snapshot(result, root, str(tmp_path / "c"), "fifty", once=True)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 49
    assert len(version_folders(root)) == 2
    batch = op.visits_by_category(parse_events(read_events_files(spark, folder, streaming=False)))
    assert rows(read_snapshot(spark, root, result.schema)) == rows(batch)
