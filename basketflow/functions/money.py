"""Sums and means of prices that do not depend on the order of addition.

A plain sum of doubles changes in its last digits with the order in which partitions
arrive, and a mean that lands near half a cent then rounds up in one run and down in the
next. A decimal sum is exact but measured about six times slower per row when many rows
meet in few groups. Here a price that is a decimal number of at most six places, as prices
are, is split into two whole numbers (units and millionths) whose bigint sums are exact,
stay inside generated code and cannot overflow at any realistic volume. Every other
price (more places, a billion and above, NaN, infinite) is added up as a double beside
them, so no value is left out.

Amounts are SQL expressions over the columns of the frame.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(amount: str) -> dict[str, str]:
    """SQL of the three partial sums of ``amount``: units, millionths, and all other doubles.

    Each is a plain sum, so parts of parts add up to the parts of the whole.
    """
    millionths = f"rint(({amount}) * 1e6D)"
    splits = f"abs({amount}) < 1e9D AND {millionths} / 1e6D = ({amount})"
    return {
        "units": f"sum(if({splits}, floor({amount}), null))",
        "millionths": f"sum(if({splits}, cast({millionths} - floor({amount}) * 1e6D AS bigint), null))",
        "others": f"sum(if({splits}, null, {amount}))",
    }


def _quotient(units: str, millionths: str, others: str, n: str) -> str:
    """The sum that the three parts stand for, divided by ``n``.

    The whole numbers meet in one division, which gives the double nearest to the true
    quotient (for sums up to nine billion; beyond, a double has no more digits to give).
    Dividing first by a million and then by ``n`` could miss a half cent.
    """
    whole = f"({units} * 1e6D + {millionths})"
    return (
        f"coalesce(try_divide({others} + coalesce({whole} / 1e6D, 0D), {n}),"
        f" try_divide({whole}, {n} * 1e6D))"
    )


def _sum_over(amount: str, n: str) -> str:
    return _quotient(*_parts(amount).values(), n)


def money_parts(amount: str, name: str) -> dict[str, Column]:
    """Aggregates ``name_units``, ``name_millionths`` and ``name_others`` of ``amount``.

    They hold the exact sum in a form that can be added up again, which a rounded sum or mean
    cannot: see :func:`merged_parts`, :func:`parts_sum` and :func:`parts_mean`.
    """
    return {f"{name}_{part}": F.expr(sql) for part, sql in _parts(amount).items()}


def merged_parts(name: str) -> dict[str, Column]:
    """Aggregates that add up the parts of several groups, under the same names."""
    return {f"{name}_{part}": F.sum(f"{name}_{part}") for part in ("units", "millionths", "others")}


def parts_sum(name: str) -> Column:
    """The sum from its parts: what :func:`exact_sum` gives over all the rows behind them."""
    return F.expr(_quotient(f"{name}_units", f"{name}_millionths", f"{name}_others", "1"))


def parts_mean(name: str, n: str) -> Column:
    """The mean from the parts and the number of rows; null when nothing is counted."""
    return F.expr(_quotient(f"{name}_units", f"{name}_millionths", f"{name}_others", n))


def exact_sum(amount: str) -> Column:
    """Sum of a double: null when every value is null, as with ``sum``."""
    return F.expr(_sum_over(amount, "1"))


def exact_mean(amount: str, where: str | None = None) -> Column:
    """Mean of ``amount``; null when nothing is counted.

    ``where`` picks the rows that make up the divisor: a sum in which other rows weigh 0
    can then serve the mean as well.
    """
    n = f"count({amount})" if where is None else f"count_if({where})"
    return F.expr(_sum_over(amount, n))


def cents(value: Column | str) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(value, 2)
