"""Rounding that does not depend on the order in which tasks add up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GUARD = 7  # digits kept beyond the result; below them lies summation noise


def half_up(value: Column, digits: int) -> Column:
    """SQL rounding: ties go away from zero on the decimal value."""
    return F.round(F.round(value, digits + _GUARD), digits)


def half_even(value: Column, digits: int) -> Column:
    """Table rounding: ties go to the even digit."""
    return F.bround(F.round(value, digits + _GUARD), digits)


def exact_half_even(value: Column, digits: int) -> Column:
    """Round a row's own value by its exact binary value, ties to even.

    293.15 is stored a little below and gives 293.1; ``bround`` sees the text
    ``293.15`` and gives 293.2. Meant for values that come from no sum.
    """
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).try_cast("double")


def ratio(num: Column, den: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return F.try_divide(num, den)
