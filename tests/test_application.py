import subprocess
import sys
from pathlib import Path
from unittest import mock

import pytest

from basketflow import operators as op
from basketflow.__main__ import parse_arguments
from basketflow.plans import application
from basketflow.plans.application import Settings, jobs, run, start, stop
from basketflow.sources import parse_events, read_events_files, read_result
from tests.conftest import event, rows


def test_jobs_of_the_application():
    listed = {job.name: job for job in jobs(Settings("base"))}
    assert len(listed) == 10
    assert {j.table for j in listed.values()} == {
        None, "users", "categories", "products", "sales_per_minute"
    }
    assert listed["top_viewed_products"].arguments == {"n": 5}
    assert listed["average_ticket_per_user"].num_rows == 10
    assert listed["demand_peaks"].mode == "append"
    assert listed["demand_peaks"].arguments == {"width": "1 minute", "threshold": 10}
    assert listed["aggregate_by_user"].arguments == {"width": "5 minutes"}
    assert len(jobs(Settings("base", sales_table=False))) == 9


def test_every_operator_names_fields_it_can_run_on(spark):
    raw = spark.createDataFrame([("{}",)], "value string")
    for job in jobs(Settings("base")):
        events = parse_events(raw, fields=job.operator.fields)
        assert job.operator(events, **job.arguments).columns


def test_all_queries_together(spark, drop_files, tmp_path):
    batches = [
        [
            event(f"00:{minute:02d}:{i:02d}", ["view", "add_to_cart", "purchase"][i % 3], user=i % 4)
            for i in range(30)
        ]
        for minute in range(0, 20, 4)
    ]
    folder = drop_files(*batches)
    settings = Settings(str(tmp_path / "base"), str(tmp_path / "checkpoints"))
    raw = read_events_files(spark, folder)
    queries = start(spark, settings, raw, once=True)
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    for query in queries:
        query.awaitTermination()
        assert query.exception() is None
        assert query.recentProgress
    assert (tmp_path / "checkpoints" / "sales_table").is_dir()

    events = parse_events(read_events_files(spark, folder, streaming=False))
    for table, operator in [
        ("users", op.aggregate_by_user),
        ("categories", op.aggregate_by_category),
        ("products", op.aggregate_by_product),
    ]:
        stored = read_result(spark, f"{settings.base_path}/{table}", table)
        closed = operator(events).where("window_end <= timestamp'2025-01-01 00:14:29'")
        assert rows(stored) == rows(closed)
        assert stored.count() > 0
    sales = read_result(spark, f"{settings.base_path}/sales_per_minute", "sales_per_minute")
    assert op.sales_series(sales).count() == 4

    again = start(spark, settings, raw, once=True)
    for query in again:
        query.awaitTermination()
    users = read_result(spark, f"{settings.base_path}/users", "users")
    assert rows(users) == rows(
        op.aggregate_by_user(events).where("window_end <= timestamp'2025-01-01 00:14:29'")
    )


def test_a_job_that_cannot_start_stops_the_others(spark, drop_files, tmp_path, monkeypatch):
    monkeypatch.setattr(
        application, "start_parquet", mock.Mock(side_effect=RuntimeError("no disk"))
    )
    settings = Settings(str(tmp_path / "base"), str(tmp_path / "checkpoints"))
    raw = read_events_files(spark, drop_files([event()]))
    with pytest.raises(RuntimeError, match="no disk"):
        start(spark, settings, raw)
    assert spark.streams.active == []


@pytest.mark.parametrize("failure", [None, RuntimeError("query failed")])
def test_run_stops_everything(monkeypatch, failure):
    ended, alive = mock.Mock(isActive=False), mock.Mock(isActive=True)
    monkeypatch.setattr(application, "start", lambda *a, **k: [ended, alive])
    monkeypatch.setattr(application, "parse_events", mock.Mock())
    monkeypatch.setattr(application, "_topics", mock.Mock())
    session = mock.Mock()
    session.streams.awaitAnyTermination.side_effect = failure
    if failure is None:
        run(session, Settings("base"))
    else:
        with pytest.raises(RuntimeError, match="query failed"):
            run(session, Settings("base"))
    alive.stop.assert_called_once()
    ended.stop.assert_not_called()
    session.stop.assert_called_once()


LIFECYCLE = """
import sys, threading, time
sys.path.insert(0, {repo!r})
from basketflow.plans.application import Settings, run
from basketflow.plans.session import build_session
from basketflow.sources import read_events_files

spark = build_session("life", "local[4]", {{
    "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false"}})
spark.sparkContext.setLogLevel("ERROR")
streams = spark.streams

def end_one():
    while len(streams.active) < 10:
        time.sleep(0.2)
    queries = streams.active
    for query in queries:
        query.processAllAvailable()
    queries[0].stop()

threading.Thread(target=end_one, daemon=True).start()
settings = Settings({base!r}, {checkpoints!r}, metric_every="1 second", table_every="1 second")
run(spark, settings, read_events_files(spark, {folder!r}))
print("STOPPED", spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped())
"""


def test_run_for_real(drop_files, tmp_path):
    """Ten continuous queries in a session of their own; one ends, all end."""
    script = LIFECYCLE.format(
        repo=str(Path(application.__file__).parents[2]), base=str(tmp_path / "base"),
        checkpoints=str(tmp_path / "checkpoints"), folder=drop_files([event()]),
    )
    done = subprocess.run(
        [sys.executable, "-c", script], capture_output=True, text=True, timeout=240
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert "STOPPED True" in done.stdout
    assert "conversion_rate: 1 input_rows, 0 late" in done.stdout
    assert "-- location: struct" in done.stdout and "-- event_time: timestamp" in done.stdout
    for heading in ("avg_transaction", "view_count", "purchase_count", "view_to_cart_rate",
                    "|add_to_cart|", "Batch: 0"):
        assert heading in done.stdout


def test_stop_leaves_ended_queries_alone():
    ended = mock.Mock(isActive=False)
    stop([ended])
    ended.stop.assert_not_called()


def test_one_that_cannot_be_stopped_does_not_keep_the_others():
    stuck, alive = mock.Mock(isActive=True), mock.Mock(isActive=True)
    stuck.stop.side_effect = TimeoutError("still busy")
    with pytest.raises(TimeoutError):
        stop([stuck, alive])
    alive.stop.assert_called_once()


def finish(queries):
    for query in queries:
        query.awaitTermination()


def test_second_start_resumes_with_default_settings(spark, drop_files, tmp_path):
    """Windows of the second run appear once, those of the first are not written again."""
    settings = Settings(str(tmp_path / "base"))
    folder = drop_files([event("00:01:00"), event("00:20:00")])
    finish(start(spark, settings, read_events_files(spark, folder), once=True))
    first = read_result(spark, f"{settings.base_path}/users", "users").collect()
    drop_files([event("00:31:00"), event("01:00:00")])
    finish(start(spark, settings, read_events_files(spark, folder), once=True))
    second = read_result(spark, f"{settings.base_path}/users", "users")
    assert len(first) == 1 and second.count() == second.distinct().count() == 3


def test_base_paths_have_checkpoints_of_their_own(spark, tmp_path):
    roots = {application._checkpoint_root(spark, Settings(str(tmp_path / n))) for n in "ab"}
    assert roots == {f"{tmp_path}/a/_checkpoints", f"{tmp_path}/b/_checkpoints"}


def test_lost_checkpoint_is_refused(spark, drop_files, tmp_path):
    raw = read_events_files(spark, drop_files([event("00:01:00"), event("00:20:00")]))
    base = str(tmp_path / "base")
    finish(start(spark, Settings(base, str(tmp_path / "one")), raw, once=True))
    with pytest.raises(ValueError, match="whose checkpoint is not"):
        start(spark, Settings(base, str(tmp_path / "two")), raw, once=True)


def test_kafka_is_the_default_source(monkeypatch, spark, tmp_path):
    asked = {}
    monkeypatch.setattr(
        application, "read_events_kafka", lambda s, **k: asked.update(k) or 1 / 0
    )
    with pytest.raises(ZeroDivisionError):
        start(spark, Settings(str(tmp_path), topics="a,b", max_per_trigger=None, min_partitions=64))
    assert asked == {
        "servers": "localhost:9092", "topics": ["a", "b"], "starting": "latest",
        "max_per_trigger": None, "min_partitions": 64, "fail_on_data_loss": False,
    }


def test_command_line():
    chosen = parse_arguments(
        ["--base-path", "/data", "--max-per-trigger", "none", "--top-n", "7", "--no-sales-table"]
    )
    assert chosen == Settings("/data", max_per_trigger=None, top_n=7, sales_table=False)
    with pytest.raises(SystemExit):
        parse_arguments([])
