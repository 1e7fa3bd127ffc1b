"""A start that asks for something else than its checkpoint holds is refused."""

import json
import os

import pytest

from basketflow.plans.application import Settings, start
from basketflow.sources import read_events_files, read_result, stored_days
from basketflow.streaming import ChangedQuery
from basketflow.streaming.guard import state_partitions
from tests.conftest import event


def starter(spark, folder, base):
    def go(partitions="4", **settings):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            for query in start(spark, Settings(base, **settings), read_events_files(spark, folder), once=True):
                query.awaitTermination()
                assert query.exception() is None
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    go()
    return go


@pytest.fixture
def begun(spark, drop_files, tmp_path):
    folder = drop_files([event("00:01:00"), event("00:20:00")])
    return starter(spark, folder, str(tmp_path / "base"))


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """One application, for tests that add nothing to it: its base path, and how to start it."""
    place = tmp_path_factory.mktemp("guard")
    (place / "incoming").mkdir()
    lines = [json.dumps(e | {"timestamp": e["timestamp"].isoformat()}) for e in (event("00:01:00"), event("00:20:00"))]
    (place / "incoming" / "part-0.json").write_text("\n".join(lines))
    return place / "base", starter(spark, str(place / "incoming"), str(place / "base"))


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"table_width": "10 minutes"}, "made with arguments .*5 minutes.*not .*10 minutes"),
        ({"peak_threshold": 3}, "threshold"),
        ({"parts": True}, "arguments|columns"),
        ({"running_totals": True}, "made with operator top_viewed_products"),
        ({"partitions": "6"}, "in 4 partitions, but spark.sql.shuffle.partitions is 6"),
    ],
)
def test_changes_are_refused(spark, shared, change, message):
    with pytest.raises(ChangedQuery, match=message):
        shared[1](**change)
    assert spark.streams.active == []


def test_unchanged_start_resumes(spark, begun, drop_files, tmp_path):
    drop_files([event("00:31:00"), event("01:00:00")])
    begun()
    assert read_result(spark, str(tmp_path / "base" / "users"), "users").count() == 3


def test_what_may_change(shared):
    """How often, how many files and how late: nothing that is in the state."""
    shared[1](table_every="1 minute", table_files=1, delay="5 minutes")


def test_number_of_state_partitions_is_read_from_the_checkpoint(spark, shared):
    checkpoints = shared[0] / "_checkpoints"
    assert state_partitions(spark, str(checkpoints / "aggregate_by_user")) == {"stateStoreSave 0": 4}
    assert state_partitions(spark, str(checkpoints / "none")) == {}


def test_checkpoint_without_a_note_is_taken_as_it_is(begun, tmp_path):
    checkpoints = tmp_path / "base" / "_checkpoints"
    for name in os.listdir(checkpoints):
        if name.endswith(".plan") and not name.startswith("."):
            os.remove(checkpoints / name)
    begun()
    with pytest.raises(ChangedQuery, match="6"):
        begun(partitions="6")


def test_table_keeps_its_layout(spark, drop_files, tmp_path):
    folder = drop_files([event("00:01:00"), event("00:20:00")])
    base = str(tmp_path / "base")
    for name, by_day in (("flat", False), ("flat", True), ("days", True)):
        for query in start(spark, Settings(f"{base}/{name}", by_day=by_day), read_events_files(spark, folder), once=True):
            query.awaitTermination()
            assert query.exception() is None
        drop_files([event("00:40:00"), event("00:50:00")])
    assert stored_days(spark, f"{base}/flat/users") == []
    assert len(stored_days(spark, f"{base}/days/users")) == 1
    assert read_result(spark, f"{base}/flat/users", "users").count() == 3
