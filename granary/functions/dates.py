"""Dates: parsing text, and the end of the period a date falls in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ValidationError
from granary.functions.kinds import CATEGORICAL, DATETIME, col, kind_of

# Text layouts read as a date, with the shape a text must have for each.
DATE_LAYOUTS = {
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd HH:mm": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ssXXX": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "yyyy-MM-dd HH:mm:ss.SSSSSSSSS": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,9}$",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,9}$",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,9}(Z|[+-]\d{2}:\d{2})$",
    "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Z][a-z]{3,8} \d{1,2}, \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Z][a-z]{2} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Z][a-z]{3,8} \d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$",
    "yyyyMMdd": r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$",
}

# Period rules from fine to coarse, with the days one point covers.
PERIODS = {"D": 1, "W": 7, "ME": 30, "QE": 91, "YE": 365}


# Two short numbers and a year, with a time or without: the order of day and month is open.
_ORDERED = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
#: What a column's numbers allow: a first or a second number above 12 settles the order.
DAY_FIRST, MONTH_FIRST, MIXED, OPEN = "day first", "month first", "mixed", "open"
#: Texts that are longer have no mask; no date is.
LONGEST_MASK = 40


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, _ORDERED, group)


def _number(c: Column, group: int) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(_part(c, group), F.lit("")), F.lit("9999")).cast("int"), F.lit(0))


def _ordered_datetime(c: Column, order: str) -> Column:
    """Two numbers and a year as a timestamp: in the column's order, else in the one that fits.

    Where the column leaves the order open, dots stand for day first and the others for month first.
    """
    first, second = _number(c, 1), _number(c, 3)
    dotted = _part(c, 2) == "."
    day_first = {DAY_FIRST: F.lit(True), MONTH_FIRST: F.lit(False)}.get(order, dotted)
    day_first = F.when((first > 12) & (second <= 12), True).when((second > 12) & (first <= 12), False).otherwise(day_first)
    month, day = F.when(day_first, second).otherwise(first), F.when(day_first, first).otherwise(second)
    clock = [_number(c, g) for g in (5, 6, 7)]
    return F.try_make_timestamp_ntz(_number(c, 4), month, day, clock[0], clock[1], clock[2].cast("decimal(16,6)"))


def parse_datetime(c: Column, order: str = OPEN) -> Column:
    """A timestamp from text in one of the accepted layouts, else null.

    ``order`` is what ``date_orders`` says of the column. A text is parsed only in the layout
    whose shape it has: a failed parse costs far more than a failed pattern.
    """
    tries = [
        F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(layout)).cast("timestamp_ntz"))
        for layout, shape in DATE_LAYOUTS.items()
    ]
    ordered = F.when(c.rlike(_ORDERED), _ordered_datetime(c, order))
    return F.when(c.rlike(r"^(\d|[A-Z][a-z]{2,8} \d)"), F.coalesce(ordered, *tries))


def mask(c: Column) -> Column:
    """The shape of a text: digits as 0, letters as a, all else as it is. Long texts have none."""
    shape = F.regexp_replace(F.regexp_replace(c, r"\p{N}", "0"), r"\p{L}", "a")
    return F.when(F.length(c) <= LONGEST_MASK, shape)


def mask_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mask, rows, first_over_12, second_over_12)`` of text columns, in one scan.

    Texts are counted by shape in each task before they are shuffled. The last two columns count
    those whose first or second number can't be a month, where the shape is two numbers and a year.
    """
    if not columns:
        raise ValidationError("No text columns to take masks of")
    pairs = [e for c in columns for e in (F.lit(c), col(c).cast("string"))]
    texts = df.select(F.stack(F.lit(len(columns)), *pairs).alias("column", "text")).where("text is not null")
    text = F.col("text")
    over = [F.count_if(text.rlike(_ORDERED) & (_number(text, g) > 12)) for g in (1, 3)]
    return texts.groupBy("column", mask(text).alias("mask")).agg(
        F.count("*").alias("rows"), over[0].alias("first_over_12"), over[1].alias("second_over_12")
    )


def date_orders(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The order of day and month in each text column, from all of its values."""
    total = mask_counts(df, columns).groupBy("column").agg(
        (F.sum("first_over_12") > 0).alias("first"), (F.sum("second_over_12") > 0).alias("second")
    )
    known = {(True, False): DAY_FIRST, (False, True): MONTH_FIRST, (True, True): MIXED, (False, False): OPEN}
    found = {r["column"]: known[r["first"], r["second"]] for r in total.collect()}
    return {c: found.get(c, OPEN) for c in columns}


def as_datetime(df: DataFrame, column: str, min_usable: int | None = None, order: str | None = None) -> Column:
    """The column as a timestamp. ``min_usable`` makes one pass to reject a non-date column.

    The order of day and month in text is taken from all values of the column, in one pass,
    where ``order`` doesn't state it.
    """
    dtype = df.schema[column].dataType
    kind = kind_of(dtype)
    if kind == DATETIME:
        return col(column).cast("timestamp_ntz")
    if kind != CATEGORICAL or isinstance(dtype, T.NullType):
        raise ValidationError(f"'{column}' can't be read as dates")
    order = order or date_orders(df, [column])[column]
    parsed = parse_datetime(col(column), order)
    if min_usable is not None and df.agg(F.count(parsed)).first()[0] < min_usable:
        raise ValidationError(f"'{column}' can't be read as dates")
    return parsed


def period_end(c: Column, freq: str) -> Column:
    """Last day of the day, week (ending Sunday), month, quarter or year of a date."""
    day = c.cast("date")
    if freq == "D":
        return day
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if freq == "ME":
        return F.last_day(day)
    if freq == "QE":
        return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    if freq == "YE":
        return F.last_day(F.add_months(F.trunc(day, "year"), 11))
    raise ValidationError(f"Unknown frequency '{freq}'. Use one of {', '.join(PERIODS)}")


def auto_freq(span_days: int, max_points: int = 400) -> str:
    """The finest rule that keeps the line within ``max_points`` points."""
    span = max(span_days, 1)
    fitting = [rule for rule, days in PERIODS.items() if span / days <= max_points]
    return fitting[0] if fitting else "YE"


def month(c: Column) -> Column:
    return F.month(c)


def weekday(c: Column) -> Column:
    """Monday is 0."""
    return F.weekday(c)
