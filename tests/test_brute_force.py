"""Every operator against plain Python over random rows with nulls in every field."""

import random
from collections import defaultdict
from datetime import timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest

from basketflow import operators as op
from tests.conftest import event, naive, rows

KINDS = ["view", "add_to_cart", "purchase", "signup", None]
SHOPPING = KINDS[:3]


def random_rows(seed, n=3000):
    chance = random.Random(seed)

    def maybe(value):
        return None if chance.random() < 0.05 else value

    made = []
    for _ in range(n):
        row = event(
            "00:00:00", chance.choice(KINDS), maybe(chance.randrange(6)),
            maybe(chance.randrange(5)), maybe(chance.choice("ABC")),
            maybe(round(chance.uniform(0, 3), chance.choice([0, 2, 3, 6]))),
            maybe(chance.choice(["Quito", "Manta"])),
        )
        # A third of the rows in one minute.
        offset = 0 if chance.random() < 0.33 else chance.randrange(3600)
        row["timestamp"] = maybe(row["timestamp"] + timedelta(seconds=offset, microseconds=1))
        made.append(row)
    return made


@pytest.fixture(scope="module", params=[1, 2])
def data(request):
    return random_rows(request.param)


def half_up(value):
    return None if value is None else float(value.quantize(Decimal("0.01"), ROUND_HALF_UP))


def prices(group):
    return [Decimal(str(r["price"])) for r in group if r["price"] is not None]


def total(values):
    return sum(values) if values else None


def mean(values):
    return sum(values) / len(values) if values else None


def count(group, kind):
    return sum(r["event_type"] == kind for r in group)


def grouped(data, *keys, minutes=None, kinds=None):
    groups = defaultdict(list)
    for r in data:
        if kinds is not None and r["event_type"] not in kinds:
            continue
        key = tuple(r[k] for k in keys)
        if minutes is not None:
            if r["timestamp"] is None:
                continue
            since = (r["timestamp"].replace(tzinfo=None) - naive("00:00:00")).seconds // 60
            key = (naive("00:00:00") + timedelta(minutes=since - since % minutes), *key)
        groups[key].append(r)
    return groups.items()


def same(frame, wanted):
    assert rows(frame) == sorted(wanted, key=lambda r: tuple(map(str, r)))
    assert wanted


def test_sales_per_minute(make_events, data):
    wanted = []
    for (minute,), group in grouped(data, minutes=1, kinds=["purchase"]):
        paid = prices(group)
        exact = total(paid)
        wanted.append(
            (minute, None if exact is None else float(exact), len(group), half_up(mean(paid)))
        )
    same(op.sales_per_minute(make_events(*data)), wanted)


def test_top_viewed_products(make_events, data):
    wanted = [(*key, len(group)) for key, group in grouped(data, "product_id", "category", kinds=["view"])]
    same(op.top_viewed_products(make_events(*data), 1000), wanted)


def test_average_ticket_per_user(make_events, data):
    wanted = [
        (user, half_up(mean(prices(group))), half_up(total(prices(group))), len(group))
        for (user,), group in grouped(data, "user_id", kinds=["purchase"])
    ]
    same(op.average_ticket_per_user(make_events(*data)), wanted)


def test_conversion_rate(make_events, data):
    wanted = []
    for (minute,), group in grouped(data, minutes=1):
        views, carts, bought = (count(group, k) for k in SHOPPING)
        rates = [
            half_up(Decimal(100 * part) / base) if base else 0.0
            for part, base in [(carts, views), (bought, carts), (bought, views)]
        ]
        wanted.append((minute, views, carts, bought, *rates))
    same(op.conversion_rate(make_events(*data)), wanted)


def test_visits_by_category(make_events, data):
    wanted = [
        (minute, minute + timedelta(minutes=1), category, *(count(group, k) for k in SHOPPING))
        for (minute, category), group in grouped(data, "category", minutes=1, kinds=SHOPPING)
    ]
    same(op.visits_by_category(make_events(*data)), wanted)


def test_demand_peaks(make_events, data):
    wanted = [
        (*key, len(group))
        for key, group in grouped(data, "category", "city", minutes=1)
        if len(group) > 10
    ]
    same(op.demand_peaks(make_events(*data)), wanted)


@pytest.mark.parametrize(
    "operator, keys",
    [
        (op.aggregate_by_user, ["user_id"]),
        (op.aggregate_by_category, ["category"]),
        (op.aggregate_by_product, ["product_id", "category"]),
    ],
    ids=["user", "category", "product"],
)
def test_rollups(make_events, data, operator, keys):
    wanted = []
    for (start, *key), group in grouped(data, *keys, minutes=5):
        bought = [r for r in group if r["event_type"] == "purchase"]
        paid = prices(bought)
        spent = total(paid) if paid or len(bought) == len(group) else Decimal(0)
        row = [start, start + timedelta(minutes=5), *key, *(count(group, k) for k in SHOPPING)]
        row += [half_up(spent), half_up(mean(paid))]
        if operator is op.aggregate_by_product:
            seen = prices(group)
            row += [half_up(max(seen, default=None)), half_up(min(seen, default=None))]
        wanted.append(tuple(row))
    same(operator(make_events(*data)), wanted)


def test_reports(make_events, data):
    events = make_events(*data)
    products = defaultdict(int)
    for (product, category), group in grouped(
        [r for r in data if r["timestamp"] is not None], "product_id", "category"
    ):
        if product is not None and category is not None:
            products[product, category] += count(group, "view")
    ranked = sorted(products.items(), key=lambda item: (-item[1], item[0]))[:10]
    found = [tuple(r) for r in op.top_products(op.aggregate_by_product(events)).collect()]
    assert found == [(*key, views) for key, views in ranked]

    newest = max(key[0] for key, _ in grouped(data, minutes=5))
    wanted = [
        (category, *(count(group, k) for k in SHOPPING))
        for (start, category), group in grouped(data, "category", minutes=5)
        if start == newest
    ]
    same(op.latest_category_activity(op.aggregate_by_category(events)), wanted)
