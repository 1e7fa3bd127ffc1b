import pytest

from basketflow import operators as op
from basketflow.schema import TABLE_SCHEMAS
from tests.conftest import event, naive, rows

START, END = naive("00:00:00"), naive("00:05:00")


def test_by_user(make_events):
    events = make_events(
        event("00:00:00", "view", user=1), event("00:04:59.999999", "view", user=1),
        event("00:01:00", "add_to_cart", user=2), event("00:02:00", "purchase", user=2, price=1.01),
        event("00:02:00", "purchase", user=2, price=1.02), event("00:05:00", "view", user=1),
        event("00:03:00", "signup", user=3, price=7.0),
    )
    assert rows(op.aggregate_by_user(events)) == [
        (START, END, 1, 2, 0, 0, 0.0, None),
        (START, END, 2, 0, 1, 2, 2.03, 1.02),
        (START, END, 3, 0, 0, 0, 0.0, None),
        (END, naive("00:10:00"), 1, 1, 0, 0, 0.0, None),
    ]


def test_null_price_alone_gives_null_and_beside_others_zero(make_events):
    alone = make_events(event(kind="purchase", price=None))
    assert rows(op.aggregate_by_user(alone)) == [(START, END, 1, 0, 0, 1, None, None)]
    beside = make_events(event(kind="purchase", price=None), event(kind="view"))
    assert rows(op.aggregate_by_user(beside)) == [(START, END, 1, 1, 0, 1, 0.0, None)]
    both = make_events(event(kind="purchase", price=None), event(kind="purchase", price=4.0))
    assert rows(op.aggregate_by_user(both)) == [(START, END, 1, 0, 0, 2, 4.0, 4.0)]


def test_by_category_keeps_null(make_events):
    events = make_events(
        event(category=None), event(kind="purchase", price=3.0), event(kind="add_to_cart")
    )
    assert rows(op.aggregate_by_category(events)) == [
        (START, END, None, 1, 0, 0, 0.0, None), (START, END, "Toys", 0, 1, 1, 3.0, 3.0),
    ]


def test_by_product_price_range_is_over_all_kinds(make_events):
    events = make_events(
        event(kind="view", price=90.0), event(kind="purchase", price=10.0),
        event(kind="signup", price=2.005), event(product=2, price=None),
    )
    assert rows(op.aggregate_by_product(events)) == [
        (START, END, 1, "Toys", 1, 0, 1, 10.0, 10.0, 90.0, 2.01),
        (START, END, 2, "Toys", 1, 0, 0, 0.0, None, None, None),
    ]


@pytest.mark.parametrize(
    "table, operator",
    [
        ("users", op.aggregate_by_user),
        ("categories", op.aggregate_by_category),
        ("products", op.aggregate_by_product),
        ("sales_per_minute", op.sales_per_minute),
    ],
)
def test_schema_is_that_of_the_stored_table(spark, make_events, table, operator):
    wanted = spark.createDataFrame([], TABLE_SCHEMAS[table])
    assert operator(make_events(event(kind="purchase"))).dtypes == wanted.dtypes
