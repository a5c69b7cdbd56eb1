"""Column kinds, name resolution and null normalisation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ValidationError
from granary.session import local_frame

NUMERIC = "numeric"
BOOLEAN = "boolean"
DATETIME = "datetime"
CATEGORICAL = "categorical"
OTHER = "other"


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, (T.StringType, T.NullType)):
        return CATEGORICAL
    return OTHER


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind in wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is grouped rather than measured: text, flags and dates."""
    return columns_of(df, CATEGORICAL, BOOLEAN, DATETIME)


def column_kinds(df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark type, kind."""
    rows = [
        (i, f.name, f.dataType.simpleString(), kind_of(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    schema = "position int, column string, dtype string, kind string"
    return local_frame(df.sparkSession, rows, schema)


def resolve(df: DataFrame, name: str, role: str = "the request") -> str:
    """Exact name, else a case-insensitive match, else an error that lists the columns."""
    if name in df.columns:
        return name
    folded = {c.lower(): c for c in df.columns}
    found = folded.get(str(name).lower())
    if found is None:
        raise ValidationError(f"No column '{name}' for {role}; the table has {df.columns[:40]}")
    return found


def resolve_all(df: DataFrame, names: Iterable[str], role: str) -> list[str]:
    return [resolve(df, n, role) for n in names]


def require_numeric(df: DataFrame, name: str, fn: str) -> None:
    if kinds(df)[name] != NUMERIC:
        raise ValidationError(f"{fn} takes numbers, which '{name}' doesn't hold")


def normalise_nulls(df: DataFrame) -> DataFrame:
    """NaN and infinities become null. Spark's avg and max would otherwise propagate them."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    if not floats:
        return df
    inf = float("inf")
    return df.select(
        *[
            F.when(~F.isnan(col(c)) & (F.abs(col(c)) != inf), col(c)).alias(c)
            if c in floats
            else col(c)
            for c in df.columns
        ]
    )


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which every named column has a value."""
    names = resolve_all(df, columns, "drop_null_rows")
    for name in names:
        df = df.where(col(name).isNotNull())
    return df
