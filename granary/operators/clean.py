"""Cleaning: text to numbers, empty columns, duplicates, imputation and outlier rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ValidationError
from granary.functions.kinds import CATEGORICAL, NUMERIC, col, columns_of, kind_of, kinds
from granary.functions.text_numbers import numeric_text
from granary.operators.counts import modes, per_column
from granary.operators.profiling import iqr_bounds, missing_counts
from granary.operators.quantiles import quantiles
from granary.session import local_frame, settled

NUMERIC_STRATEGIES = ("median", "mean", "zero")
CATEGORICAL_STRATEGIES = ("mode", "constant")
MIN_PARSE_RATIO = 0.8
REPORT_SCHEMA = "step string, column string, detail string, count long"


def numeric_text_columns(df: DataFrame) -> list[str]:
    """Text columns that are really measurements: 80% read as numbers, more than one value."""
    names = [c for c in columns_of(df, CATEGORICAL) if isinstance(df.schema[c].dataType, T.StringType)]
    if not names:
        return []
    measures = {
        "values": lambda c: F.count(col(c)),
        "parsed": lambda c: F.count(numeric_text(col(c))),
        "low": lambda c: F.min(numeric_text(col(c))),
        "high": lambda c: F.max(numeric_text(col(c))),
    }
    return [
        r["column"]
        for r in per_column(df, names, measures).collect()
        if r["values"] and r["parsed"] >= MIN_PARSE_RATIO * r["values"] and r["low"] != r["high"]
    ]


def read_as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: numeric_text(col(c)) for c in columns}) if columns else df


def coerce_numeric_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    names = numeric_text_columns(df)
    return read_as_numbers(df, names), names


# -- imputation ------------------------------------------------------------


def _check_strategies(numeric: str, categorical: str) -> None:
    if numeric not in NUMERIC_STRATEGIES:
        raise ValidationError(f"Unknown numeric imputation '{numeric}'.")
    if categorical not in CATEGORICAL_STRATEGIES:
        raise ValidationError(f"Unknown categorical imputation '{categorical}'.")


def fit_fills(
    df: DataFrame, columns: Sequence[str], numeric: str = "median", categorical: str = "mode"
) -> dict[str, float | str]:
    """The value each column is filled with: a number, or the text of a value."""
    _check_strategies(numeric, categorical)
    kind = kinds(df)
    numbers = [c for c in columns if kind[c] == NUMERIC]
    others = [c for c in columns if kind[c] != NUMERIC]
    fills: dict[str, float | str] = {}
    if numbers and numeric == "median":
        fills |= {c: q[0] or 0.0 for c, q in quantiles(df, numbers, [0.5]).items()}
    elif numbers and numeric == "mean":
        means = per_column(df, numbers, {"mean": lambda c: F.avg(col(c).cast("double"))})
        fills |= {r["column"]: r["mean"] or 0.0 for r in means.collect()}
    else:
        fills |= dict.fromkeys(numbers, 0.0)
    constant = [
        c for c in others
        if categorical == "constant" and isinstance(df.schema[c].dataType, T.StringType)
    ]
    fills |= dict.fromkeys(constant, "missing")
    counted = [c for c in others if c not in constant]
    found = modes(df, counted)
    fills |= {c: found.get(c, "unknown") for c in counted}
    return fills


def filled(dtype: T.DataType, c: Column, value: float | str) -> Column:
    if kind_of(dtype) == NUMERIC:
        return F.coalesce(c.cast("double"), F.lit(float(value)))
    target = T.StringType() if isinstance(dtype, T.NullType) else dtype
    return F.coalesce(c, F.lit(value).try_cast(target.simpleString()))


def apply_fills(df: DataFrame, fills: dict[str, float | str]) -> DataFrame:
    """Fill gaps with values decided earlier; filled numeric columns become double."""
    if not fills:
        return df
    return df.withColumns({c: filled(df.schema[c].dataType, col(c), v) for c, v in fills.items()})


def impute(
    df: DataFrame, numeric: str = "median", categorical: str = "mode"
) -> tuple[DataFrame, DataFrame]:
    """Fill every column that has gaps. Also returns ``(column, strategy, value, count)``."""
    _check_strategies(numeric, categorical)
    gaps = {r["column"]: r["missing"] for r in missing_counts(df).collect() if r["missing"]}
    fills = fit_fills(df, list(gaps), numeric, categorical)
    return apply_fills(df, fills), _fill_table(df, fills, gaps, numeric, categorical)


def _fill_table(df, fills, gaps, numeric, categorical) -> DataFrame:
    kind = kinds(df)
    rows = [
        (c, numeric if kind[c] == NUMERIC else categorical, str(fills[c]), gaps[c]) for c in fills
    ]
    schema = "column string, strategy string, value string, count long"
    return local_frame(df.sparkSession, rows, schema)


# -- the full clean --------------------------------------------------------


@dataclass(frozen=True)
class Cleaned:
    frame: DataFrame
    report: DataFrame
    coerced: list[str]
    removed: list[str]
    duplicates: int
    fills: dict


def clean_dataset(df: DataFrame, numeric: str = "median", categorical: str = "mode") -> Cleaned:
    """Text to numbers, drop empty columns, drop duplicates, impute; with a report.

    Duplicates are removed once, by one shuffle whose result is a checkpoint that the counts, the
    fills and the cleaned table read. When there are none the result carries no shuffle at all.
    """
    _check_strategies(numeric, categorical)
    frame, coerced = coerce_numeric_columns(df)
    before = missing_counts(frame).collect()
    rows_before = before[0]["rows"]
    removed = [r["column"] for r in before if r["missing"] == r["rows"]]
    frame = frame.drop(*[col(c) for c in removed]) if removed else frame
    if not frame.columns:
        raise ValidationError("No column of the table has a value")
    unique = settled(frame.dropDuplicates())
    after = missing_counts(unique).collect()
    duplicates = rows_before - after[0]["rows"]
    gaps = {r["column"]: r["missing"] for r in after if r["missing"]}
    fills = fit_fills(unique, list(gaps), numeric, categorical)
    kept = unique if duplicates else frame
    kind = kinds(kept)
    report = [("rows_before", None, None, rows_before), ("rows_after", None, None, after[0]["rows"])]
    report += [("read_as_number", c, None, None) for c in coerced]
    report += [("drop_empty_column", c, None, rows_before) for c in removed]
    report += [("drop_duplicates", None, None, duplicates)] if duplicates else []
    report += [
        ("impute_" + (numeric if kind[c] == NUMERIC else categorical), c, str(v), gaps[c])
        for c, v in fills.items()
    ]
    table = local_frame(df.sparkSession, report, REPORT_SCHEMA)
    return Cleaned(apply_fills(kept, fills), table, coerced, removed, duplicates, fills)


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    counted = missing_counts(df).collect()
    removed = [r["column"] for r in counted if r["missing"] == r["rows"]]
    return df.select(*[col(c) for c in df.columns if c not in removed]), removed


# -- outlier rows ----------------------------------------------------------


def outlier_condition(df: DataFrame, columns: Sequence[str]) -> Column:
    """True where any column lies outside its bounds; columns without spread are ignored."""
    bounds = iqr_bounds(df, columns)
    usable = {c: b for c, b in bounds.items() if b[1] > b[0]}
    outside = [(col(c) < low) | (col(c) > high) for c, (low, high) in usable.items()]
    return F.coalesce(reduce(Column.__or__, outside, F.lit(False)), F.lit(False))


def outlier_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table with a flag column ``is_outlier``."""
    return df.withColumn("is_outlier", outlier_condition(df, columns))


@dataclass(frozen=True)
class Trimmed:
    frame: DataFrame
    rows_removed: int
    rows: int
    flagged: int


def drop_outliers(
    df: DataFrame, columns: Sequence[str], max_loss: float = 0.5, inclusive: bool = False
) -> Trimmed:
    """Drop flagged rows unless that would lose too much of the table."""
    condition = outlier_condition(df, columns)
    rows, flagged = df.agg(F.count(F.lit(1)), F.count_if(condition)).first()
    fits = flagged <= max_loss * rows if inclusive else flagged < max_loss * rows
    if not flagged or not fits:
        return Trimmed(df, 0, rows, flagged)
    return Trimmed(df.where(~condition), flagged, rows, flagged)
