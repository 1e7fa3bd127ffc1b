"""Running totals as partial results: equal to complete mode, late rows, repeats and merges."""

import os

import pytest

from basketflow import operators as op
from basketflow.operators import totals
from basketflow.plans.application import Settings, start
from basketflow.sources import parse_events, read_events_files
from basketflow.streaming import merge_totals, read_snapshot, read_totals, start_snapshot, start_totals
from tests.conftest import event, rows

KINDS = {
    "views": (totals.views_per_product(3), lambda e: op.top_viewed_products(e, 3)),
    "tickets": (totals.ticket_per_user(), op.average_ticket_per_user),
    "visits": (totals.visits_per_category(), op.visits_by_category),
}


def batches(n=8):
    """Every third batch is hours late."""
    kinds = ["view", "add_to_cart", "purchase", "purchase", None]
    return [
        [
            event(
                f"{(9 if batch % 3 else 0) + batch % 2:02d}:{batch:02d}:{i:02d}", kinds[i % 5], user=i % 4,
                product=i % 6, category=["Toys", None][i % 2], price=[1.005, 2.675, None, 0.1][i % 4],
            )
            for i in range(25)
        ]
        + ["no json"]
        for batch in range(n)
    ]


@pytest.fixture
def run(spark, tmp_path):
    def go(folder, total, max_files=1, **settings):
        raw = read_events_files(spark, folder, max_files=max_files)
        query = start_totals(
            parse_events(raw, fields=total.partial.fields), total, str(tmp_path / "totals"),
            str(tmp_path / "c"), once=True, **settings,
        )
        query.awaitTermination()
        return query

    return go


def kept(tmp_path):
    return sorted(n for n in os.listdir(tmp_path / "totals") if "=" in n)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("merge_every", [None, 3])
def test_equal_to_complete_mode(spark, drop_files, tmp_path, run, kind, merge_every):
    total, operator = KINDS[kind]
    folder = drop_files(*batches())
    query = run(folder, total, merge_every=merge_every)
    assert query.lastProgress["stateOperators"] == []
    complete = operator(parse_events(read_events_files(spark, folder, max_files=1)))
    start_snapshot(complete, str(tmp_path / "s"), str(tmp_path / "sc"), "complete", once=True).awaitTermination()
    wanted = read_snapshot(spark, str(tmp_path / "s"), complete.schema)
    found = read_totals(spark, total, str(tmp_path / "totals"))
    assert rows(found) == rows(wanted) and found.columns == wanted.columns
    assert not wanted.isEmpty()


def test_merged_batches_stay_the_same_and_go(spark, drop_files, tmp_path, run):
    total, operator = KINDS["tickets"]
    folder = drop_files(*batches(10))
    run(folder, total, merge_every=4)
    # Two merges; what went into the first is gone, what went into the second still lies there.
    assert kept(tmp_path) == [*(f"batch={n:012d}" for n in range(4, 10)), "upto=000000000003", "upto=000000000007"]
    before = rows(read_totals(spark, total, str(tmp_path / "totals")))
    assert merge_totals(spark, total, str(tmp_path / "totals")) == 9
    assert rows(read_totals(spark, total, str(tmp_path / "totals"))) == before
    assert merge_totals(spark, total, str(tmp_path / "totals")) == 9
    drop_files(*batches(3))
    run(folder, total, merge_every=4)
    events = parse_events(read_events_files(spark, folder, streaming=False))
    assert rows(read_totals(spark, total, str(tmp_path / "totals"))) == rows(operator(events))


def test_a_repeated_batch_counts_once(spark, drop_files, tmp_path, run):
    """The commit of the last batch is lost: the second start repeats it, merged or not."""
    total, operator = KINDS["visits"]
    folder = drop_files(*batches(4))
    for merge in (False, True):
        run(folder, total, merge_every=None)
        if merge:
            merge_totals(spark, total, str(tmp_path / "totals"))
        last = max(n for n in os.listdir(tmp_path / "c" / "commits") if n.isdigit())
        for name in (last, f".{last}.crc"):
            if (tmp_path / "c" / "commits" / name).exists():
                os.remove(tmp_path / "c" / "commits" / name)
        run(folder, total, merge_every=None)
        events = parse_events(read_events_files(spark, folder, streaming=False))
        assert rows(read_totals(spark, total, str(tmp_path / "totals"))) == rows(operator(events))


def test_nothing_written_yet(spark, tmp_path):
    for total, _ in KINDS.values():
        assert read_totals(spark, total, str(tmp_path / "none")).isEmpty()
        assert merge_totals(spark, total, str(tmp_path / "none")) == -1


def test_application_keeps_no_unbounded_state(spark, drop_files, tmp_path, capsys):
    folder = drop_files(*batches(3))
    settings = Settings(str(tmp_path / "base"), running_totals=True, sales_table=False)
    queries = start(spark, settings, read_events_files(spark, folder), once=True)
    for query in queries:
        query.awaitTermination()
        assert query.exception() is None
    stateless = {q.name for q in queries if not q.lastProgress["stateOperators"]}
    assert stateless == {"top_viewed_products", "average_ticket_per_user", "visits_by_category"}
    printed = capsys.readouterr().out
    assert "view_count" in printed and "avg_ticket" in printed and "add_to_cart" in printed
    events = parse_events(read_events_files(spark, folder, streaming=False))
    found = read_totals(spark, totals.ticket_per_user(), f"{settings.base_path}/_totals/average_ticket_per_user")
    assert rows(found) == rows(op.average_ticket_per_user(events))
