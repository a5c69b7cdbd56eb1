"""Numbers written as text, read with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted notations and their multipliers.
FEET_INCHES = r"""^\s*(\d+)\s*'\s*(\d+(?:\.\d+)?)\s*"?\s*$"""
ADDITIVE = r"^\s*(-?\d+(?:\.\d+)?)\s*\+\s*(\d+(?:\.\d+)?)\s*$"
UNIT_NUMBER = r"(?i)^\s*[^\d\-+.]*\s*(-?\d+(?:[.,]\d+)?)\s*([kmb])?\s*[^\d]*$"
MULTIPLIERS = {"k": 1e3, "m": 1e6, "b": 1e9}


def to_number(c: Column) -> Column:
    """Double, or null where the value is not a number."""
    return c.try_cast("double")


def feet_inches(c: Column) -> Column:
    """``5'7`` is 67 inches."""
    feet = F.regexp_extract(c, FEET_INCHES, 1).try_cast("double")
    inches = F.regexp_extract(c, FEET_INCHES, 2).try_cast("double")
    return feet * 12 + inches


def additive(c: Column) -> Column:
    """``88+2`` is 90."""
    left = F.regexp_extract(c, ADDITIVE, 1).try_cast("double")
    right = F.regexp_extract(c, ADDITIVE, 2).try_cast("double")
    return left + right


def unit_number(c: Column) -> Column:
    """``€110.5M`` is 110500000, ``159lbs`` is 159, ``1,250`` is 1250."""
    bare = F.regexp_replace(c, ",", "")
    number = F.regexp_extract(bare, UNIT_NUMBER, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(bare, UNIT_NUMBER, 2))
    factor = F.lit(1.0)
    for letter, value in MULTIPLIERS.items():
        factor = F.when(unit == letter, F.lit(value)).otherwise(factor)
    return number * factor


def numeric_text(c: Column) -> Column:
    """The number in a text, tried as feet and inches, then as a sum, then with units.

    The cheap tests in front spare most texts most of the patterns.
    """
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    parsed = F.coalesce(
        F.when(F.contains(text, F.lit("'")), feet_inches(text)),
        F.when(F.contains(text, F.lit("+")), additive(text)),
        unit_number(text),
    )
    return F.when(c.rlike("[0-9]"), parsed)
