import re

import pytest

from basketflow import operators as op
from basketflow.schema import PURCHASE
from basketflow.sources import parse_events, read_events_files, read_result
from basketflow.streaming import (
    read_snapshot, shared_root, start_console, start_parquet, start_snapshot, workspace,
)
from tests.conftest import event, naive, rows

COMPLETE = [
    op.sales_per_minute, op.top_viewed_products, op.average_ticket_per_user,
    op.conversion_rate, op.visits_by_category,
]
APPEND = [
    op.demand_peaks, op.aggregate_by_user, op.aggregate_by_category, op.aggregate_by_product,
]


@pytest.fixture
def run_append(spark, tmp_path):
    """Run an operator in append mode over what is in the folder; the table so far."""

    def run(folder, operator, max_files=1, name="append", **settings):
        arguments = settings.pop("arguments", {})
        raw = read_events_files(spark, folder, max_files=max_files)
        result = operator(parse_events(raw, fields=operator.fields), **arguments)
        query = start_parquet(
            result, str(tmp_path / name / "table"), str(tmp_path / name / "state"), name,
            once=True, **settings,
        )
        query.awaitTermination()
        table = spark.read.schema(result.schema).parquet(str(tmp_path / name / "table"))
        return table, query

    return run


def mixed_batches():
    kinds = ["view", "add_to_cart", "purchase", "signup"]
    return [
        [
            event(
                f"00:{2 * batch + i % 2:02d}:{i:02d}", kinds[i % 4], user=i % 3, product=i % 5,
                category=["Toys", "Books"][i % 2], price=i / 100,
            )
            for i in range(40)
        ]
        for batch in range(6)
    ]


@pytest.mark.parametrize("operator", COMPLETE, ids=lambda o: o.__name__)
def test_complete_mode_equals_batch(spark, drop_files, tmp_path, operator):
    folder = drop_files(*mixed_batches())
    events = parse_events(read_events_files(spark, folder, max_files=3), fields=operator.fields)
    result = operator(events)
    start_snapshot(
        result, str(tmp_path / "t"), str(tmp_path / "c"), operator.__name__, once=True
    ).awaitTermination()
    stored = read_snapshot(spark, str(tmp_path / "t"), result.schema)
    batch = operator(parse_events(read_events_files(spark, folder, streaming=False)))
    assert rows(stored) == rows(batch)
    assert batch.count() > 0


@pytest.mark.parametrize("operator", APPEND, ids=lambda o: o.__name__)
def test_append_mode_equals_batch_for_closed_windows(spark, drop_files, run_append, operator):
    files = 2 if operator is op.aggregate_by_user else None
    folder = drop_files(*mixed_batches())
    arguments = {"threshold": 4} if operator is op.demand_peaks else {}
    table, _ = run_append(folder, operator, max_files=2, arguments=arguments, files=files)
    batch = operator(
        parse_events(read_events_files(spark, folder, streaming=False)), **arguments
    )
    newest = naive("00:11:39")
    end = "peak_time + interval 1 minute" if operator is op.demand_peaks else "window_end"
    closed = batch.where(f"{end} <= timestamp'{newest}' - interval 2 minutes")
    assert rows(table) == rows(closed)
    assert 0 < closed.count() < batch.count()


def late_batches():
    return [
        [event("00:00:10")], [event("00:10:00")], [event("00:10:30")],
        [event("00:00:30")], [event("00:30:00")],
    ]


def one_minute_users(events):
    return op.aggregate_by_user(events, width="1 minute")


one_minute_users.fields = op.aggregate_by_user.fields


def test_late_rows_of_closed_windows_are_dropped(drop_files, run_append):
    table, query = run_append(drop_files(*late_batches()), one_minute_users)
    assert rows(table, "window_start", "total_views") == [
        (naive("00:00:00"), 1), (naive("00:10:00"), 2),
    ]
    dropped = sum(
        state["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for state in progress["stateOperators"]
    )
    assert dropped == 1


def test_complete_mode_keeps_late_rows(spark, drop_files, tmp_path):
    raw = read_events_files(spark, drop_files(*late_batches()), max_files=1)
    result = op.conversion_rate(parse_events(raw))
    start_snapshot(
        result, str(tmp_path / "t"), str(tmp_path / "c"), "late_complete", once=True
    ).awaitTermination()
    stored = read_snapshot(spark, str(tmp_path / "t"), result.schema)
    assert rows(stored, "minute", "views") == [
        (naive("00:00:00"), 2), (naive("00:10:00"), 2), (naive("00:30:00"), 1),
    ]


def test_snapshot_that_fails_half_way_is_not_seen(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t" / "batch=000000000000"))
    torn = tmp_path / "t" / "batch=000000000001"
    spark.range(9).write.parquet(str(torn))
    (torn / "_SUCCESS").unlink()
    schema = spark.range(1).schema
    assert read_snapshot(spark, str(tmp_path / "t"), schema).count() == 3
    assert read_snapshot(spark, str(tmp_path / "none"), schema).count() == 0


def test_restart_loses_and_repeats_nothing(drop_files, run_append):
    folder = drop_files(*late_batches()[:3])
    first, _ = run_append(folder, one_minute_users)
    assert rows(first, "window_start") == [(naive("00:00:00"),)]
    again, _ = run_append(folder, one_minute_users)
    assert again.count() == 1
    drop_files([event("00:30:00")])
    table, _ = run_append(folder, one_minute_users)
    assert rows(table, "window_start", "total_views") == [
        (naive("00:00:00"), 1), (naive("00:10:00"), 2),
    ]


def test_stored_sales_close_with_the_newest_purchase(spark, drop_files, run_append):
    batch = [
        event("00:00:10", PURCHASE, price=1.5), event("00:04:00", PURCHASE, price=2.5),
        event("00:30:00", "view"),
    ]
    table, _ = run_append(drop_files(batch), op.sales_per_minute, arguments={"ordered": False})
    assert rows(table) == [(naive("00:00:00"), 1.5, 1, 1.5)]


def test_malformed_records_do_not_move_the_watermark(drop_files, run_append):
    lines = ["garbage", "", '{"user_id": 1}', '{"timestamp": "never"}']
    table, _ = run_append(
        drop_files([event("00:00:10")], lines, [event("00:04:00")], lines), one_minute_users
    )
    assert rows(table, "window_start", "total_views") == [(naive("00:00:00"), 1)]


@pytest.mark.parametrize(
    "operator", [op.top_viewed_products, op.average_ticket_per_user, op.visits_by_category]
)
def test_metrics_without_watermark_cannot_append(drop_files, run_append, operator):
    with pytest.raises(Exception, match="UNSUPPORTED_OPERATION|append"):
        run_append(drop_files([event()]), operator)


def test_visits_can_append_on_event_time(drop_files, run_append):
    folder = drop_files([event("00:00:10")], [event("00:10:00")])
    table, _ = run_append(folder, op.visits_by_category, arguments={"time_col": "event_time"})
    assert rows(table, "window_start", "views") == [(naive("00:00:00"), 1)]


def test_partitioned_table(spark, drop_files, tmp_path):
    raw = read_events_files(spark, drop_files([event("00:00:10")], [event("00:20:00")]), max_files=1)
    users = op.aggregate_by_user(parse_events(raw)).selectExpr(
        "*", "to_date(window_start) AS day"
    )
    path = str(tmp_path / "t")
    start_parquet(
        users, path, str(tmp_path / "c"), "by_day", partition_by=["day"], once=True
    ).awaitTermination()
    assert read_result(spark, path, "users").count() == 1
    assert (tmp_path / "t" / "day=2025-01-01").is_dir()


def test_console_is_given_no_more_rows_than_it_shows(spark, drop_files, tmp_path):
    batch = [event("00:00:10", PURCHASE, user=u, price=float(u)) for u in range(1, 51)]
    raw = read_events_files(spark, drop_files(batch))
    tickets = op.average_ticket_per_user(parse_events(raw))
    query = start_console(
        tickets, "console", num_rows=10, once=True, checkpoint=str(tmp_path / "c")
    )
    query.awaitTermination()
    assert query.recentProgress[0]["sink"]["numOutputRows"] == 11


def test_console_limit_leaves_the_state_whole(spark, drop_files, tmp_path):
    batches = [
        [event(f"00:00:{i:02d}", category=f"c{b}-{i}") for i in range(50)] for b in range(3)
    ]
    raw = read_events_files(spark, drop_files(*batches), max_files=1)
    query = start_console(
        op.visits_by_category(parse_events(raw)), "many", num_rows=2, once=True,
        checkpoint=str(tmp_path / "c"),
    )
    query.awaitTermination()
    assert [p["sink"]["numOutputRows"] for p in query.recentProgress] == [3, 3, 3]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 150


def test_console_in_append_mode(spark, drop_files, tmp_path, capsys):
    crowd = [event("00:00:10", category=f"c{i % 9}") for i in range(99)]
    folder = drop_files(crowd, [event("00:10:00")], [event("00:20:00")])

    def run():
        raw = read_events_files(spark, folder, max_files=1)
        query = start_console(
            op.demand_peaks(parse_events(raw)), "peaks", mode="append", num_rows=4, once=True,
            checkpoint=str(tmp_path / "c"),
        )
        query.awaitTermination()
        return capsys.readouterr().out

    printed = run()
    assert "rows: 9" in printed and "only showing top 4 rows" in printed
    assert len(re.findall(r"\|c\d", printed)) == 4
    drop_files([event("00:30:00", category="z")] * 11, [event("00:50:00")])
    later = run()
    assert "rows: 1" in later and "|z " in later and not re.search(r"\|c\d", later)


def test_triggers_and_names(spark, drop_files, tmp_path):
    folder = drop_files([event("00:00:10")], [event("00:10:00")])
    users = op.aggregate_by_user(parse_events(read_events_files(spark, folder)))
    query = start_parquet(
        users, str(tmp_path / "t"), str(tmp_path / "c"), "every_second", every="1 second"
    )
    try:
        query.processAllAvailable()
        assert query.isActive and query.name == "every_second"
        assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    finally:
        query.stop()


def test_default_checkpoint_root_of_the_session(spark, drop_files, tmp_path):
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "root"))
    try:
        raw = read_events_files(spark, drop_files([event()]))
        start_console(
            op.conversion_rate(parse_events(raw)), "named", once=True
        ).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.checkpointLocation")
    assert (tmp_path / "root" / "named" / "offsets").is_dir()


def test_workspace_is_new_and_below_the_shared_folder(spark):
    first, second = workspace(spark, "x"), workspace(spark, "x")
    assert first != second
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert first.startswith(root.rstrip("/"))


def test_shared_root_on_a_cluster_must_be_named():
    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Session)
    Session.sparkContext.master = "local[2]"
    assert shared_root(Session)
