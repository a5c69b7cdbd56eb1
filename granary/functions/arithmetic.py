"""Scalar arithmetic that never raises: derived columns and scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.errors import ValidationError
from granary.functions.text_numbers import to_number

DERIVED_KINDS = ("product", "ratio", "difference")
SMALLEST_DENOMINATOR = 1e-9


def finite(c: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def derive(kind: str, a: Column, b: Column) -> Column:
    """Product, difference or ratio of two columns; a vanishing denominator gives null."""
    left, right = to_number(a), to_number(b)
    if kind == "product":
        return finite(left * right)
    if kind == "difference":
        return finite(left - right)
    if kind == "ratio":
        safe = F.when(F.abs(right) > SMALLEST_DENOMINATOR, right)
        return finite(F.try_divide(left, safe))
    raise ValidationError(f"Unknown derived column kind '{kind}'")


def standardise(c: Column, mean: float, scale: float) -> Column:
    """``(x - mean) / scale``; a zero scale counts as 1."""
    return (c.cast("double") - F.lit(float(mean))) / F.lit(float(scale) if scale else 1.0)


def round_half_up(c: Column, digits: int) -> Column:
    return F.round(c, digits)
