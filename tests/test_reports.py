import pytest

from basketflow import operators as op
from basketflow.schema import TABLE_SCHEMAS
from basketflow.sources import read_result
from tests.conftest import event, naive, rows


def store(frame, path):
    frame.write.parquet(str(path))
    return str(path)


def test_sales_series_is_oldest_first(spark, make_events, tmp_path):
    sales = op.sales_per_minute(
        make_events(event("00:03:00", "purchase", price=2.5), event("00:01:00", "purchase"))
    )
    table = read_result(spark, store(sales, tmp_path / "t"), "sales_per_minute")
    found = [tuple(r) for r in op.sales_series(table).collect()]
    assert found == [(naive("00:01:00"), 1.0), (naive("00:03:00"), 2.5)]


def test_latest_category_activity(spark, make_events, tmp_path):
    categories = op.aggregate_by_category(
        make_events(
            event("00:00:00", category="Home"), event("00:07:00", "purchase"),
            event("00:08:00", "add_to_cart", category="Books"), event("00:09:00", category=None),
        )
    )
    table = read_result(spark, store(categories, tmp_path / "t"), "categories")
    assert rows(op.latest_category_activity(table)) == [
        ("Books", 0, 1, 0), (None, 1, 0, 0), ("Toys", 0, 0, 1),
    ]


def test_user_behaviour_has_one_point_per_window_and_user(make_events):
    users = op.aggregate_by_user(
        make_events(event("00:00:00"), event("00:06:00"), event("00:06:00", "purchase"))
    )
    assert rows(op.user_behaviour(users)) == [(1, 1, 0, 0), (1, 1, 1, 0)]


def test_top_products_sums_windows_and_drops_null_keys(make_events):
    products = op.aggregate_by_product(
        make_events(
            event("00:00:00", product=1), event("00:06:00", product=1), event(product=3),
            event(product=2), event(product=5, category=None), event(product=None),
            event(product=8, kind="purchase"),
        )
    )
    found = [tuple(r) for r in op.top_products(products).collect()]
    assert found == [(1, "Toys", 2), (2, "Toys", 1), (3, "Toys", 1), (8, "Toys", 0)]
    assert op.top_products(products, 2).count() == 2


REPORTS = {
    "sales_per_minute": op.sales_series,
    "categories": op.latest_category_activity,
    "users": op.user_behaviour,
    "products": op.top_products,
}


@pytest.mark.parametrize("table", TABLE_SCHEMAS)
def test_tables_not_yet_written_give_empty_reports(spark, tmp_path, table):
    missing = read_result(spark, str(tmp_path / "missing"), table)
    (tmp_path / "bare").mkdir()
    bare = read_result(spark, str(tmp_path / "bare"), table)
    for frame in (missing, bare):
        report = REPORTS[table](frame)
        assert report.isEmpty() and report.columns


def test_partition_columns_of_the_layout_are_left_out(spark, make_events, tmp_path):
    users = op.aggregate_by_user(make_events(event()))
    users.selectExpr("*", "to_date(window_start) AS day").write.partitionBy("day").parquet(
        str(tmp_path / "t")
    )
    assert read_result(spark, str(tmp_path / "t"), "users").columns == users.columns


def test_other_errors_are_not_hidden(spark):
    with pytest.raises(Exception, match="nosuchfs"):
        read_result(spark, "nosuchfs://x/y", "users")
