"""Derived figures: formulas over facts, their units, and checks of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

#: Relative difference of two sides that still balance, and of a figure computed anew.
BALANCE_TOLERANCE, RECOMPUTE_TOLERANCE = 0.005, 1e-6


def sum_of(*values: Column | str) -> Column:
    total = col(values[0])
    for v in values[1:]:
        total = total + col(v)
    return total


def difference(a: Column | str, b: Column | str) -> Column:
    return col(a) - col(b)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b to four places; null if b is 0 or null."""
    return F.round(F.try_divide(col(a), F.nullif(col(b), F.lit(0))), 4)


def percent_of(part: Column | str, whole: Column | str) -> Column:
    return F.round(F.try_divide(col(part) * 100, F.nullif(col(whole), F.lit(0))), 2)


def percent_change(new: Column | str, old: Column | str) -> Column:
    """Change against the size of old, to two places; null if old is 0 or null."""
    return F.round(F.try_divide((col(new) - col(old)) * 100, F.nullif(F.abs(col(old)), F.lit(0))), 2)


@dataclass(frozen=True)
class Formula:
    compute: Callable[..., Column]
    same_units: bool
    result_unit: str | None  # that of the inputs if None


FORMULAS = {
    "sum": Formula(sum_of, True, None),
    "difference": Formula(difference, True, None),
    "percent_change": Formula(percent_change, True, "percent"),
    "ratio": Formula(ratio, True, "ratio"),
    "percent_of": Formula(percent_of, True, "percent"),
}


def balances(assets: Column | str, others: Column | str) -> Column:
    """Whether both sides agree within half a percent of the larger."""
    a, b = col(assets), col(others)
    return F.abs(a - b) <= BALANCE_TOLERANCE * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def recomputes(stated: Column | str, computed: Column | str) -> Column:
    s = col(stated)
    return F.abs(s - col(computed)) <= F.greatest(F.lit(RECOMPUTE_TOLERANCE), F.abs(s) * RECOMPUTE_TOLERANCE)
