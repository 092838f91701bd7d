"""Row-wise arithmetic, selection and conditions as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """True division; null where the divisor is zero."""
    return F.when(b != 0, a / b)


def floor_divide(a: Column, b: Column) -> Column:
    """Quotient rounded down; null where the divisor is zero."""
    return F.when(b != 0, F.floor(a / b))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null where it is zero."""
    return F.when(b != 0, a - b * F.floor(a / b))


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def root(x: Column, n: float) -> Column:
    """n-th root that keeps the sign of x."""
    return F.signum(x) * F.pow(F.abs(x), F.lit(1.0 / n))


def total(*xs: Column) -> Column:
    """Sum that skips nulls; 0 for nothing."""
    return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in xs], F.lit(0))


def product(*xs: Column) -> Column:
    """Product, null if any factor is; 1 for nothing."""
    return reduce(lambda a, b: a * b, xs, F.lit(1))


def first_known(*xs: Column) -> Column:
    return F.coalesce(*xs) if xs else F.lit(None)


def largest(*xs: Column) -> Column:
    """Largest of the known values."""
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def choose(condition: Column, then: Column, other: Column) -> Column:
    """``then`` where the condition is true; a null condition counts as false."""
    return F.when(condition, then).otherwise(other)
