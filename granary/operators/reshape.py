"""Two-way tables, histograms and the data behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ValidationError
from granary.functions.kinds import (
    CATEGORICAL, NUMERIC, col, columns_of, kinds, numeric_columns, require_numeric, resolve,
)
from granary.operators.counts import distinct_capped, per_column, top_values, value_counts
from granary.operators.profiling import correlation_pairs, detect_missing_values
from granary.operators.quantiles import quantiles
from granary.operators.query import (
    MAX_GROUPS, Aggregation, grouped_bounded, sample_rows, validate_aggregations,
)
from granary.session import local_frame

MAX_PIVOT_CELLS = 4 * MAX_GROUPS
BINS = 30
CHART_COLUMNS = 6


def pivot_cells(
    df: DataFrame, index: str, columns: str, values: str, aggfunc: str = "sum"
) -> DataFrame:
    """Long form of a pivot: index, column and value of every combination that occurs."""
    index, columns, values = (
        resolve(df, n, role)
        for n, role in ((index, "index"), (columns, "columns"), (values, "values"))
    )
    agg = Aggregation(values, aggfunc, "value")
    validate_aggregations(df, [agg])
    too_large = f"'{index}' x '{columns}' makes more than {MAX_PIVOT_CELLS} cells; take columns with fewer values"
    cells, _, _ = grouped_bounded(df, [index, columns], [agg], MAX_PIVOT_CELLS, too_large)
    rows = cells.collect()
    sides = [{r[i] for r in rows} - {None} for i in (0, 1)]
    if len(sides[0]) * len(sides[1]) > MAX_PIVOT_CELLS:
        raise ValidationError(too_large)
    return cells


def _label(value) -> str:
    return "null" if value is None else str(value)


def _grid(cells: DataFrame, empty) -> DataFrame:
    """Spread long cells ``(row, column, value)`` into one output column per column value."""
    index = cells.schema.fields[0]
    value_type = cells.schema["value"].dataType
    rows = cells.collect()
    order = lambda v: (v is None, v)
    across = sorted({r[1] for r in rows}, key=order)
    down = sorted({r[0] for r in rows}, key=order)
    found = {(r[0], r[1]): r["value"] for r in rows}
    schema = T.StructType(
        [T.StructField(index.name, index.dataType)]
        + [T.StructField(_label(a), value_type) for a in across]
    )
    table = [(d, *[found.get((d, a), empty) for a in across]) for d in down]
    return local_frame(cells.sparkSession, table, schema)


def pivot_table(
    df: DataFrame, index: str, columns: str, values: str, aggfunc: str = "sum"
) -> DataFrame:
    """The full index by column grid; combinations that do not occur are null."""
    return _grid(pivot_cells(df, index, columns, values, aggfunc), None)


def crosstab_cells(df: DataFrame, a: str, b: str, limit: int = MAX_PIVOT_CELLS) -> DataFrame:
    """Counts of two columns in long form, rows with a gap in either left out."""
    a, b = resolve(df, a, "crosstab"), resolve(df, b, "crosstab")
    both = df.where(col(a).isNotNull() & col(b).isNotNull())
    cells, _, _ = grouped_bounded(
        both, [a, b], [Aggregation(alias="value")], limit, f"'{a}' x '{b}' is too large"
    )
    return cells


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two columns as a grid; combinations that do not occur are 0."""
    return _grid(crosstab_cells(df, a, b), 0)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """``bins`` equal-width bins between minimum and maximum, empty bins included."""
    name = resolve(df, column, "histogram")
    require_numeric(df, name, "a histogram")
    x = col(name).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    schema = "bin int, low double, high double, count long"
    if low is None:
        return local_frame(df.sparkSession, [], schema)
    if low == high:
        n = df.agg(F.count(x)).first()[0]
        return local_frame(df.sparkSession, [(1, low, high, n)], schema)
    slot = F.least(F.width_bucket(x, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    counted = df.where(col(name).isNotNull()).groupBy(slot.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    width = (high - low) / bins
    edges = df.sparkSession.range(1, bins + 1, 1, 1).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + (F.col("id") - 1) * F.lit(width)).alias("low"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("high"),
    )
    joined = F.broadcast(edges).join(counted, "bin", "left")
    return joined.select("bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))


def chart_columns(df: DataFrame, limit: int | None = CHART_COLUMNS) -> list[str]:
    names = numeric_columns(df)
    distinct = distinct_capped(df, names, 2)
    return [c for c in names if distinct[c] > 2][:limit]


def box_summary(df: DataFrame) -> DataFrame | None:
    """Five-number summary of the first z-scored numeric columns; None below two columns."""
    names = chart_columns(df)
    if len(names) < 2:
        return None
    measures = {
        "mean": lambda c: F.avg(col(c).cast("double")),
        "std": lambda c: F.stddev_pop(col(c).cast("double")),
        "min": lambda c: F.min(col(c)).cast("double"),
        "max": lambda c: F.max(col(c)).cast("double"),
    }
    base = {r["column"]: r for r in per_column(df, names, measures).collect()}
    cuts = quantiles(df, names, [0.25, 0.5, 0.75])
    rows = []
    for c in names:
        scale = base[c]["std"] or 1.0
        five = [base[c]["min"], *cuts[c], base[c]["max"]]
        rows.append((c, *[(v - base[c]["mean"]) / scale for v in five]))
    schema = "column string, min double, q1 double, median double, q3 double, max double"
    return local_frame(df.sparkSession, rows, schema)


def missing_pct(df: DataFrame) -> DataFrame:
    return detect_missing_values(df).columns.select("column", "pct")


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """A histogram of a many-valued numeric target, else its 12 most frequent values."""
    name = resolve(df, target, "target")
    if kinds(df)[name] == NUMERIC and distinct_capped(df, [name], 8)[name] > 8:
        return histogram(df, name)
    return value_counts(df, name, 12).select(F.col("value").cast("string").alias("value"), "count")


def scatter_pairs(df: DataFrame, target: str | None) -> list[tuple[str, str, float]]:
    """The pairs to plot: two columns closest to a numeric target, else the best pair."""
    names = numeric_columns(df)
    if target is not None and target in names and distinct_capped(df, [target], 5)[target] > 5:
        others = [c for c in chart_columns(df, None) if c != target]
        if not others:
            return []
        wanted = df.agg(
            *[F.corr(col(c).cast("double"), col(target).cast("double")).alias(f"r{i}")
              for i, c in enumerate(others)]
        ).first()
        scored = [(c, target, wanted[i]) for i, c in enumerate(others) if wanted[i] is not None]
        return sorted(scored, key=lambda p: (-abs(p[2]), p[0]))[:2]
    pairs = correlation_pairs(df).where("corr is not null")
    best = pairs.orderBy(F.desc(F.abs("corr")), "a", "b").first()
    return [(best["a"], best["b"], best["corr"])] if best else []


def scatter_points(df: DataFrame, target: str | None = None, n: int | None = None) -> DataFrame:
    """``(x_column, y_column, r, x, y)`` of those pairs; ``n`` draws that many rows per pair."""
    parts = []
    for a, b, r in scatter_pairs(df, target):
        points = df.select(
            F.lit(a).alias("x_column"), F.lit(b).alias("y_column"), F.lit(r).alias("r"),
            col(a).cast("double").alias("x"), col(b).cast("double").alias("y"),
        ).where("x is not null and y is not null")
        parts.append(points if n is None else sample_rows(points, n))
    if not parts:
        schema = "x_column string, y_column string, r double, x double, y double"
        return local_frame(df.sparkSession, [], schema)
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def bar_counts(df: DataFrame, k: int = 12) -> DataFrame:
    """Most frequent values of the first two text columns with 2 to 15 values."""
    names = columns_of(df, CATEGORICAL)
    distinct = distinct_capped(df, names, 15)
    chosen = [c for c in names if 2 <= distinct[c] <= 15][:2]
    if not chosen:
        schema = "column string, rank int, value string, count long"
        return local_frame(df.sparkSession, [], schema)
    return top_values(df, chosen, k)
