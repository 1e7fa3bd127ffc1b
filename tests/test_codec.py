import math

import pytest

from basketflow.plans.retail_view import retail_view
from basketflow.schema import EVENT_SCHEMA
from basketflow.sources import encode_events, parse_events
from tests.conftest import event, naive, rows


@pytest.fixture
def parse(spark):
    def run(*texts, **settings):
        raw = spark.createDataFrame([(t,) for t in texts], "value string")
        return parse_events(raw, **settings)

    return run


WIRE = (
    '{"user_id": 17, "product_id": 203, "category": "Toys", "event_type": "view",'
    ' "price": 19.99, "timestamp": "2025-01-01T00:00:10.123456Z", "store_id": "ST007",'
    ' "store_type": "online_store", "city": "Quito", "province": "Pichincha",'
    ' "location": {"lat": -0.18, "lon": -78.47}}'
)


def test_full_record(parse):
    record = parse(WIRE).first()
    assert record[:5] == (17, 203, "Toys", "view", 19.99)
    assert record.timestamp == record.event_time == naive("00:00:10.123456")
    assert tuple(record.location) == (-0.18, -78.47)
    assert record.store_id == "ST007" and record.province == "Pichincha"


def test_binary_value(spark):
    raw = spark.createDataFrame([(bytearray(WIRE, "utf8"),)], "value binary")
    assert parse_events(raw).first().user_id == 17


def test_schema(parse):
    frame = parse(WIRE)
    assert frame.columns == EVENT_SCHEMA.names + ["event_time"]
    for field in EVENT_SCHEMA:
        assert frame.schema[field.name].dataType == field.dataType


@pytest.mark.parametrize("text", ["garbage", "", None, "[1, 2]", '[{"user_id": 1}]', "{", "12"])
def test_malformed_record_is_a_row_of_nulls(parse, text):
    found = parse(text).collect()
    assert len(found) == 1
    assert all(value is None for value in found[0])


@pytest.mark.parametrize(
    "bad",
    ['"user_id": "x"', '"user_id": 1.5', '"user_id": 99999999999', '"price": "12.5"',
     '"timestamp": "yesterday"'],
)
def test_bad_field_alone_is_null(parse, bad):
    name = bad.split('"')[1]
    record = parse(f'{{{bad}, "category": "Toys", "city": "Quito"}}').first()
    assert record[name] is None
    assert record.category == "Toys" and record.city == "Quito"


def test_bad_leaf_alone_is_null(parse):
    record = parse('{"user_id": 3, "location": {"lat": "x", "lon": 2.5}}').first()
    assert record.user_id == 3
    assert record.location.lat is None and record.location.lon == 2.5


def test_extra_and_missing_fields(parse):
    record = parse('{"user_id": 3, "colour": "red"}').first()
    assert record.user_id == 3
    assert all(record[n] is None for n in record.__fields__ if n != "user_id")


@pytest.mark.parametrize(
    "text, clock",
    [
        ('"2025-01-01T00:00:10.5Z"', "00:00:10.500000"),
        ('"2025-01-01T00:00:10Z"', "00:00:10"),
        ('"2025-01-01T00:00:10-05:00"', "05:00:10"),
        ('"2025-01-01T00:00:10"', "00:00:10"),
        ('"2025-01-01T00:00:10.123456789Z"', "00:00:10.123456"),
        ("1735689610", "00:00:10"),
    ],
)
def test_timestamp_forms(parse, text, clock):
    assert parse(f'{{"timestamp": {text}}}').first().event_time == naive(clock)


def test_not_a_number_is_a_price(parse):
    found = [r.price for r in parse('{"price": NaN}', '{"price": Infinity}').collect()]
    assert math.isnan(found[0]) and math.isinf(found[1])


def test_fields_limit_the_parse(parse):
    frame = parse(WIRE, fields=["price", "event_type"])
    assert frame.columns == ["event_type", "price", "timestamp", "event_time"]
    assert tuple(frame.first())[:2] == ("view", 19.99)


def test_unknown_field_is_refused(parse):
    with pytest.raises(ValueError, match="colour"):
        parse(WIRE, fields=["colour"])


def test_filter_does_not_copy_the_parser(parse):
    plan = parse(WIRE).where("event_type = 'view' AND price > 1")
    optimized = plan._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json") == 1


def test_round_trip_is_exact(spark, make_events):
    events = make_events(
        event("00:00:10.123456", price=0.1, category=None),
        event("00:00:59.999999", price=1499.99, category='say "hi"\n'),
        event(None, user=None, price=None),
    )
    back = parse_events(encode_events(events))
    assert rows(back) == rows(events)


def test_round_trip_of_the_test_table(spark):
    events = retail_view(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    back = parse_events(encode_events(events)).drop("event_time")
    assert back.exceptAll(events).isEmpty() and events.exceptAll(back).isEmpty()
