import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketflow.functions import cents, exact_mean, exact_sum


@pytest.fixture(scope="module")
def total(spark):
    def compute(values):
        frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        return tuple(frame.agg(exact_sum("v"), cents(exact_mean("v"))).first())

    return compute


def half_up(value: Decimal) -> float:
    return float(value.quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_half_cent_goes_up(total):
    assert total([1.01, 1.02]) == (2.03, 1.02)
    assert total([-1.01, -1.02]) == (-2.03, -1.02)


def test_half_cents_of_longer_lists(total):
    assert total([400.0, 37.58] + [0.0] * 10) == (437.58, 36.47)
    assert total([252.95] + [0.0] * 9) == (252.95, 25.3)


@pytest.mark.parametrize("n", [2, 4, 8, 12, 20, 40, 80, 120])
def test_every_tie_goes_up(spark, n):
    # Sums of whole cents whose n-th part ends in half a cent.
    frame = spark.range(1, 1001).selectExpr(
        "id", f"(id * {n} + {n // 2}) / 100D AS total", f"explode(sequence(1, {n})) AS part"
    ).selectExpr("id", "if(part = 1, total, 0D) AS v")
    means = frame.groupBy("id").agg(cents(exact_mean("v")).alias("m"))
    assert means.where("m != (id + 1) / 100D").isEmpty()


def test_sum_equals_the_decimal_sum_in_any_order(total):
    chance = random.Random(7)
    values = [round(chance.uniform(5, 1500), 2) for _ in range(3000)]
    exact = sum(Decimal(str(v)) for v in values)
    wanted = (float(exact), half_up(exact / len(values)))
    assert total(values) == wanted
    assert total(sorted(values)) == wanted


@settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.integers(-(10**14), 10**14).map(lambda n: n / 10**6), min_size=1, max_size=20))
def test_six_decimals_against_decimals(total, values):
    exact = sum(Decimal(str(v)) for v in values)
    found, mean = total(values)
    assert found == pytest.approx(float(exact), rel=1e-15, abs=0)
    assert mean == half_up(exact / len(values))


def test_nulls(total):
    assert total([None, None]) == (None, None)
    assert total([None, 4.0]) == (4.0, 4.0)


def test_nothing_is_left_out(total):
    assert total([1.5, 2e9]) == (2000000001.5, 1000000000.75)
    assert total([1e300, 1.0])[0] == 1e300
    assert math.isnan(total([float("nan"), 1.0])[0])
    assert total([float("inf"), 1.0])[0] == math.inf
    assert math.isnan(total([float("inf"), float("-inf")])[0])


def test_prices_with_many_decimals_keep_them(total):
    values = [1 / 3] * 1000
    assert total(values)[0] == pytest.approx(sum(values), rel=1e-12)


def test_sums_beyond_the_range_of_scaled_integers(spark):
    # 40 million rows of 999,999,999.99: 4e16 units, more than a bigint of millionths holds.
    frame = spark.range(0, 40_000_000, 1, 8).select(F.lit(999_999_999.99).alias("v"))
    found = frame.agg(exact_sum("v").alias("s")).first().s
    assert found == pytest.approx(40_000_000 * 999_999_999.99, rel=1e-15)
