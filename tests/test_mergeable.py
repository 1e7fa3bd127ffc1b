"""Roll-ups kept in parts, and coarser ones derived from them."""

import random

import pytest
from pyspark.errors import PySparkException

from basketflow import operators as op
from basketflow.schema import table_schema
from tests.conftest import event, rows

TABLES = {
    "users": op.aggregate_by_user,
    "categories": op.aggregate_by_category,
    "products": op.aggregate_by_product,
}
PRICES = [None, 0.0, 0.005, 1.005, 2.675, 1e9, 3e12, 0.1234567, float("nan"), float("inf"), -4.35, 19.99]


def crowd(seed):
    draw = random.Random(seed)
    return [
        event(
            f"{draw.randint(0, 23):02d}:{draw.randint(0, 59):02d}:{draw.randint(0, 59):02d}",
            draw.choice(["view", "add_to_cart", "purchase", "purchase", "other", None]),
            user=draw.choice([1, 2, None]), product=draw.choice([1, 2, 3, None]),
            category=draw.choice(["Toys", None]),
            price=draw.choice(PRICES) if seed % 2 else round(draw.uniform(0, 500), 2),
        )
        for _ in range(600)
    ]


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize("seed", [1, 2])
def test_hours_and_days_from_five_minutes(make_events, table, seed):
    events = make_events(*crowd(seed))
    fine = TABLES[table](events, parts=True)
    hours = op.coarsen(fine, table, "1 hour", parts=True)
    for derived, width in ((hours, "1 hour"), (op.coarsen(hours, table, "1 day"), "1 day"), (op.coarsen(fine, table, "1 day"), "1 day")):
        direct = TABLES[table](events, width)
        shown = derived.select(direct.columns)
        assert repr(rows(shown)) == repr(rows(direct))
        assert not shown.isEmpty()


@pytest.mark.parametrize("table", TABLES)
def test_parts_stand_beside_the_public_columns(make_events, table):
    events = make_events(event(kind="purchase", price=1.25))
    kept = TABLES[table](events, parts=True)
    assert kept.columns == table_schema(table, parts=True).names
    assert TABLES[table](events).columns == table_schema(table).names
    assert [f.dataType for f in kept.schema] == [f.dataType for f in table_schema(table, parts=True)]


def test_a_rounded_mean_cannot_be_rolled_up_but_parts_can(make_events):
    """Means of 0.005 and 0.01 over windows of one and two purchases."""
    events = make_events(
        event("00:00:00", "purchase", price=0.004), event("00:06:00", "purchase", price=0.004),
        event("00:07:00", "purchase", price=0.004),
    )
    fine = op.aggregate_by_user(events, parts=True)
    (hour,) = op.coarsen(fine, "users", "1 hour").collect()
    assert hour["total_spent"] == 0.01 and sum(r["total_spent"] for r in fine.collect()) == 0.01
    assert hour["avg_ticket"] == 0.0


def test_width_that_does_not_fit_is_refused(make_events):
    fine = op.aggregate_by_user(make_events(event("00:11:00"), event("00:02:00")), parts=True)
    with pytest.raises(PySparkException, match="lies across the bounds of 7 minutes"):
        op.coarsen(fine, "users", "7 minutes").collect()


def test_sales_hold_no_parts():
    with pytest.raises(ValueError, match="holds no parts"):
        table_schema("sales_per_minute", parts=True)


def test_one_shuffle_and_no_python(make_events, spark, tmp_path):
    op.aggregate_by_user(make_events(event()), parts=True).write.parquet(str(tmp_path / "t"))
    stored = spark.read.schema(table_schema("users", parts=True)).parquet(str(tmp_path / "t"))
    plan = op.coarsen(stored, "users", "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
    assert "SortAggregate" not in plan and "Python" not in plan
