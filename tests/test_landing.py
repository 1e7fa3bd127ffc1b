"""The landed table: every record once, refused ones apart, streams over it equal to streams over the topic."""

import json
import re

import pytest

from basketflow import operators as op
from basketflow.plans.application import Settings, jobs, start
from basketflow.sources import parse_events, read_events_files, read_result
from basketflow.streaming import Account, read_landed, read_rejected, start_landing, stream_landed
from basketflow.streaming.landing import NO_OBJECT, NO_TIME, landed
from tests.conftest import event, rows

BAD = ["", "no json", "{\"user_id\": 1", "[]", "null", "7", "{}", '{"timestamp": "never"}', '{"user_id": 3}']


def batches():
    kinds = ["view", "add_to_cart", "purchase", "signup"]
    return [
        [
            event(
                f"{hour:02d}:{batch % 60:02d}:{i:02d}", kinds[i % 4], user=i % 3, product=i % 5,
                category=["Toys", "Books", None][i % 3], price=i / 100,
            )
            for i in range(30)
        ]
        + BAD[batch % 3 :: 3] + [event(None)]
        for batch, hour in enumerate((0, 1, 23))
    ]


@pytest.fixture
def land(spark, tmp_path):
    def run(folder, max_files=1, **settings):
        raw = read_events_files(spark, folder, max_files=max_files)
        query = start_landing(raw, str(tmp_path / "landed"), str(tmp_path / "landing"), once=True, **settings)
        query.awaitTermination()
        return str(tmp_path / "landed")

    return run


def test_every_record_is_kept_once(spark, drop_files, land):
    folder = drop_files(*batches())
    path = land(folder)
    events = parse_events(read_events_files(spark, folder, streaming=False))
    timed = events.where("timestamp IS NOT NULL")
    assert rows(read_landed(spark, path)) == rows(timed)
    assert timed.count() == 90
    refused = rows(read_rejected(spark, path))
    assert len(refused) == events.count() - 90
    reasons = dict(refused)
    assert reasons["no json"] == reasons["[]"] == reasons["null"] == reasons["7"] == NO_OBJECT
    assert reasons['{"user_id": 1'] == NO_OBJECT
    assert reasons["{}"] == reasons['{"timestamp": "never"}'] == reasons['{"user_id": 3}'] == NO_TIME
    assert sum(1 for t, r in refused if r == NO_TIME and '"category"' in t) == 3


def test_a_second_run_adds_only_what_is_new(spark, drop_files, land):
    folder = drop_files(*batches())
    land(folder)
    path = land(folder)
    assert read_landed(spark, path).count() == 90
    drop_files([event("23:59:00")])
    assert read_landed(spark, land(folder)).count() == 91


def test_binary_values_and_nulls(spark):
    raw = spark.sql("SELECT cast(null AS binary) AS value UNION ALL SELECT cast('{\"timestamp\": \"2025-01-01T00:00:00Z\"}' AS binary)")
    found = landed(raw).select("rejected", "reason", "day").collect()
    assert sorted(map(str, map(tuple, found))) == [
        "('', 'no JSON object', None)", "(None, None, datetime.date(2025, 1, 1))",
    ]


@pytest.mark.parametrize(
    "operator", [op.aggregate_by_user, op.aggregate_by_category, op.aggregate_by_product, op.demand_peaks], ids=lambda o: o.__name__
)
def test_tables_are_the_same_with_and_without(spark, drop_files, tmp_path, land, operator):
    from basketflow.streaming import start_parquet

    folder = drop_files(*batches())
    path = land(folder)
    arguments = {"threshold": 2} if operator is op.demand_peaks else {}
    found = []
    direct = parse_events(read_events_files(spark, folder), fields=operator.fields)
    for name, events in (("direct", direct), ("landed", stream_landed(spark, path, fields=operator.fields))):
        result = operator(events, **arguments)
        place = str(tmp_path / name)
        start_parquet(result, f"{place}/t", f"{place}/c", name, once=True).awaitTermination()
        found.append(rows(spark.read.schema(result.schema).parquet(f"{place}/t")))
    assert found[0] == found[1] and found[0]


def test_streams_read_their_columns_and_no_refused_rows(spark, drop_files, land):
    path = land(drop_files(*batches()))
    fields = op.top_viewed_products.fields
    plan = op.top_viewed_products(read_landed(spark, path))._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert {part.split(":")[0] for part in read.split(",")} <= set(fields)
    assert "PartitionFilters: [isnotnull(day" in plan
    assert stream_landed(spark, path, fields=fields).columns == [
        "product_id", "category", "event_type", "timestamp", "event_time",
    ] or set(stream_landed(spark, path, fields=fields).columns) == {*fields, "timestamp", "event_time"}
    refused = read_rejected(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnull(day" in refused


def test_account_of_refused_and_late_rows(spark, drop_files, tmp_path):
    folder = drop_files(
        [event("00:00:10"), "no json", "{}"], [event("00:10:00")], [event("00:10:30"), event(None)],
        [event("00:00:30"), event("00:00:31"), "[]"], [event("00:30:00")],
    )
    account = Account.open(spark)
    try:
        raw = read_events_files(spark, folder, max_files=1)
        landing = start_landing(raw, str(tmp_path / "l"), str(tmp_path / "lc"), name="landing_account", once=True)
        users = op.aggregate_by_user(parse_events(raw), width="1 minute")
        from basketflow.streaming import start_parquet

        table = start_parquet(users, str(tmp_path / "t"), str(tmp_path / "c"), "users_account", once=True)
        queries = [landing, table]
        for query in queries:
            query.awaitTermination()
        account.settle(queries)
        report = account.report()
    finally:
        account.close(spark)
    assert report["landing_account"] == {"input_rows": 10, "late": 0, "records": 10, "no_object": 2, "no_time": 2}
    # Both late rows fall into one window, and are dropped after they have been added up.
    assert report["users_account"]["late"] == 1
    assert read_rejected(spark, str(tmp_path / "l")).count() == 4


def test_application_with_one_ingest(spark, drop_files, tmp_path):
    folder = drop_files(*batches())
    raw = read_events_files(spark, folder)
    results = {}
    for name, landing in (("with", True), ("without", False)):
        settings = Settings(str(tmp_path / name), landing=landing, parts=True)
        for query in start(spark, settings, raw, once=True):
            query.awaitTermination()
            assert query.exception() is None
        results[name] = {
            job.table: rows(read_result(spark, f"{tmp_path}/{name}/{job.table}", job.table))
            for job in jobs(settings) if job.table
        }
    assert results["with"] == results["without"]
    assert all(results["with"].values())
    assert json.dumps(len(rows(read_landed(spark, f"{tmp_path}/with/landed")))) == "90"
    hours = op.coarsen(read_result(spark, f"{tmp_path}/with/users", "users", parts=True), "users", "1 hour")
    assert hours.count() == 6
