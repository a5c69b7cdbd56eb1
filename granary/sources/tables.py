"""Reading tables, accepting them, and showing their first rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ValidationError
from granary.functions.kinds import col, normalise_nulls

ALTERNATE_SEPARATORS = (";", "\t", "|")
PREVIEW_ROWS = 100
# Texts read as a missing value.
NULL_TEXTS = ("", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A")


def detect_separator(spark: SparkSession, path: str) -> str:
    """Comma, unless that leaves one column and another separator splits the header."""
    lines = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if not lines:
        raise ValidationError("The file is empty.")
    header = lines[0]["value"]
    if "," in header:
        return ","
    return next((s for s in ALTERNATE_SEPARATORS if s in header), ",")


def read_csv(
    spark: SparkSession, path: str, sep: str | None = None,
    schema: T.StructType | str | None = None, multiline: bool = False,
) -> DataFrame:
    """A CSV file or folder with a header. Give a schema to save the pass that infers one.

    ``multiline`` allows line breaks inside quotes; such files cannot be split between tasks.
    """
    separator = sep or detect_separator(spark, path)
    reader = spark.read.option("header", True).option("sep", separator)
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", multiline)
    if schema is not None:
        return normalise_nulls(reader.option("nullValue", "").schema(schema).csv(path))
    text = _blank_to_null(reader.csv(path))
    return normalise_nulls(_infer_types(text))


def _blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.when(~F.trim(col(c)).isin(*NULL_TEXTS), col(c)).alias(c) for c in df.columns]
    )


def _infer_types(df: DataFrame) -> DataFrame:
    """Whole numbers, decimals and flags where every value is one; dates stay text.

    One aggregation over the file, after the texts for a missing value are gone.
    """
    wanted = []
    for i, c in enumerate(df.columns):
        value = F.trim(col(c))
        flag = F.lower(value).isin("true", "false")
        wanted += [
            F.count(value).alias(f"n{i}"),
            F.count(value.try_cast("long")).alias(f"long{i}"),
            F.count(value.try_cast("double")).alias(f"double{i}"),
            F.count_if(value.rlike(r"[fFdD]$")).alias(f"suffix{i}"),
            F.count_if(value.rlike(r"^[+-]?\d+$")).alias(f"whole{i}"),
            F.count_if(flag).alias(f"flag{i}"),
        ]
    seen = df.agg(*wanted).first()
    columns: list[Column] = []
    for i, c in enumerate(df.columns):
        n = seen[f"n{i}"]
        value = F.trim(col(c))
        if n and seen[f"long{i}"] == n and seen[f"whole{i}"] == n:
            columns.append(value.try_cast("long").alias(c))
        elif n and seen[f"double{i}"] == n and not seen[f"suffix{i}"]:
            columns.append(value.try_cast("double").alias(c))
        elif n and seen[f"flag{i}"] == n:
            columns.append((F.lower(value) == "true").alias(c))
        else:
            columns.append(col(c))
    return df.select(*columns)


def validate_table(
    df: DataFrame, max_rows: int | None = None, max_columns: int | None = None
) -> DataFrame:
    """The table itself, or an error when it holds nothing or exceeds a given cap."""
    if max_columns is not None and len(df.columns) > max_columns:
        raise ValidationError(f"Dataset has {len(df.columns)} columns; the limit is {max_columns}.")
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)],
    ).first()
    if counted["rows"] == 0:
        raise ValidationError("No rows in the table")
    if max_rows is not None and counted["rows"] > max_rows:
        raise ValidationError(f"{counted['rows']} rows, but {max_rows} at most are taken")
    if not any(counted[1:]):
        raise ValidationError("No column of the table has a value")
    return df


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows, decimals rounded to 6 places (2 from a billion on)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]

    def shown(c: str) -> Column:
        if c not in floats:
            return col(c)
        large = F.abs(col(c)) >= 1e9
        return F.when(large, F.round(col(c), 2)).otherwise(F.round(col(c), 6)).alias(c)

    return df.limit(n).select(*[shown(c) for c in df.columns])

