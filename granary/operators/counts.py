"""Counting values: frequencies, most common values, modes and distinct counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.kinds import col, resolve
from granary.session import chunks

DISTINCT_PER_JOB = 10


def value_counts(df: DataFrame, column: str, k: int | None = None, keep_null: bool = False):
    """Value, count and share in percent, most frequent first; ties by value."""
    name = resolve(df, column, "value_counts")
    data = df.select(col(name).alias("value"))
    if not keep_null:
        data = data.where(F.col("value").isNotNull())
    total = data.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = data.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    shared = counted.withColumn(
        "share_pct", F.round(100.0 * F.col("count") / total.cast("double"), 2)
    )
    ordered = shared.orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return ordered if k is None else ordered.limit(k)


def melted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column, value)`` of several columns as text, nulls left out."""
    if len(columns) == 1:
        name = columns[0]
        long = df.select(F.lit(name).alias("column"), col(name).cast("string").alias("value"))
        return long.where("value is not null")
    slots = {f"c{i}": c for i, c in enumerate(columns)}
    texts = df.select(*[col(c).cast("string").alias(s) for s, c in slots.items()])
    names = F.create_map(*[F.lit(x) for pair in slots.items() for x in pair])
    long = texts.unpivot([], list(slots), "slot", "value").where("value is not null")
    return long.select(names[F.col("slot")].alias("column"), "value")


def value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` for all columns with one shuffle of partial counts."""
    return melted(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_k_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group. Spark prunes to ``k`` per task before it shuffles."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def top_k(df: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """``(column, rank, value, count)``: the most frequent values; ties by value."""
    table = value_table(df, columns)
    best = top_k_per(table, ["column"], [F.desc("count"), F.asc("value")], k)
    return best.select("column", "rank", "value", "count")


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties."""
    if not columns:
        return {}
    return {r["column"]: r["value"] for r in top_values(df, columns, 1).collect()}


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: dict[str, Callable[[str], Column]],
    per_job: int | None = None,
) -> DataFrame:
    """One aggregation over many columns, turned into one row per column.

    ``measures`` maps an output name to a function from the column name to an aggregate.
    """
    if not columns:
        raise ValueError("per_column needs at least one column")
    parts = []
    for part in chunks(list(enumerate(columns)), per_job or max(len(columns), 1)):
        wide = df.agg(
            *[make(c).alias(f"{name}_{i}") for i, c in part for name, make in measures.items()]
        )
        rows = [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                *[F.col(f"{name}_{i}").alias(name) for name in measures],
            )
            for i, c in part
        ]
        parts.append(wide.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.union, parts)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> dict:
    """Distinct non-null values per column, a few columns per job."""
    if not columns:
        return {}
    if approximate:
        fn, per_job = (lambda c: F.approx_count_distinct(col(c))), None
    else:
        fn, per_job = (lambda c: F.countDistinct(col(c))), DISTINCT_PER_JOB
    found = per_column(df, columns, {"distinct": fn}, per_job)
    return {r["column"]: r["distinct"] for r in found.collect()}


def distinct_capped(df: DataFrame, columns: Sequence[str], cap: int) -> dict[str, int]:
    """Distinct counts that are exact up to ``cap``; above it, only known to be above.

    A cheap sketch sorts out the columns far above the cap, so the exact count, which must
    shuffle every distinct value, touches only columns with few of them.
    """
    if not columns:
        return {}
    estimate = distinct_counts(df, columns, approximate=True)
    low = [c for c in columns if estimate[c] <= 2 * cap + 10]
    return {**estimate, **distinct_counts(df, low)}
