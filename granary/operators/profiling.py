"""Profiling: structure, gaps, duplicates, statistics, correlation, outliers and roles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation as MLCorrelation
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.errors import ValidationError
from granary.functions.dates import parse_datetime
from granary.functions.kinds import (
    BOOLEAN, CATEGORICAL, DATETIME, NUMERIC, categorical_columns, col, column_kinds, columns_of,
    kind_of, kinds, numeric_columns, resolve,
)
from granary.operators.counts import (
    DISTINCT_PER_JOB, distinct_capped, distinct_counts, per_column, top_k_per, top_values,
    value_table,
)
from granary.operators.quantiles import quantiles
from granary.session import local_frame

MAX_CARDINALITY = 50
TOP_PAIRS = 10
OUTLIER_MIN_DISTINCT = 8
IQR_FACTOR = 1.5
DIMENSION_LIMIT = 15
DASHBOARD_DIMENSION_LIMIT = 20
FILTER_VALUES = 25
MIN_DATED = 4

# Words in a column name that mark an identifier, a target or a date.
ID_HINTS = ("id", "index", "uuid", "key", "code", "zip", "zipcode", "email", "name")
TARGET_HINTS = (
    "target", "label", "outcome", "result", "prediction", "predicted", "response", "dep", "y",
    "churn", "price", "salary", "sales", "revenue", "survived", "default", "fraud", "win",
    "approve", "purchase", "buy",
)
DATE_HINTS = (
    "date", "time", "day", "month", "year", "created", "updated", "timestamp", "period", "when",
    "at",
)
# Pairs of texts read as yes and no.
BINARY_PAIRS = (
    {"yes", "no"}, {"true", "false"}, {"0", "1"}, {"good", "bad"}, {"churned", "not_churned"},
)


@dataclass(frozen=True)
class Profile:
    summary: DataFrame
    columns: DataFrame


def _profilable(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC, CATEGORICAL, BOOLEAN, DATETIME)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one. Nulls count as equal."""
    per_row = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies"))
    extra = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long")
    return per_row.agg(extra.alias("duplicate_rows"))


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, kind, rows, missing, distinct."""
    count_of = F.approx_count_distinct if approximate else F.countDistinct
    measures = {
        "rows": lambda c: F.count(F.lit(1)),
        "missing": lambda c: F.count_if(col(c).isNull()),
        "distinct": lambda c: count_of(col(c)),
    }
    found = per_column(df, _profilable(df), measures, None if approximate else DISTINCT_PER_JOB)
    named = column_kinds(df).select("column", "dtype", "kind")
    return found.join(F.broadcast(named), "column").select(
        "position", "column", "dtype", "kind", "rows", "missing", "distinct"
    )


def analyze_dataset(df: DataFrame, approximate: bool = False) -> Profile:
    """Size, duplicates and empty columns of the table, and a row per column."""
    columns = column_profile(df, approximate)
    gaps = columns.agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sort_array(
            F.collect_list(F.when(F.col("missing") == F.col("rows"), F.col("column")))
        ).alias("empty_columns"),
    )
    summary = gaps.withColumn("duplicate_rows", duplicate_rows(df).scalar())
    return Profile(summary, columns)


# -- gaps ------------------------------------------------------------------


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column, in one scan: rows and missing."""
    measures = {
        "rows": lambda c: F.count(F.lit(1)),
        "missing": lambda c: F.count_if(col(c).isNull()),
    }
    return per_column(df, columns or df.columns, measures)


@dataclass(frozen=True)
class MissingAudit:
    totals: DataFrame
    columns: DataFrame


def detect_missing_values(df: DataFrame) -> MissingAudit:
    """Columns with gaps, largest first, and totals over all cells."""
    counted = missing_counts(df)
    numeric = numeric_columns(df)
    share = 100.0 * F.col("missing") / F.greatest(F.col("rows"), F.lit(1))
    fill = F.when(F.col("column").isin(*numeric), "median").otherwise("mode") if numeric else "mode"
    columns = (
        counted.where("missing > 0")
        .select(
            "column", "missing", F.round(share, 2).alias("pct"),
            (fill if numeric else F.lit(fill)).alias("imputation"),
        )
        .orderBy(F.desc("missing"), "column")
    )
    cells = F.greatest(F.sum("rows"), F.lit(1))
    totals = counted.agg(
        F.sum("missing").alias("total_missing"),
        F.round(100.0 * F.sum("missing") / cells, 2).alias("pct_missing"),
        F.count_if(F.col("missing") > 0).alias("columns_affected"),
        F.count_if(F.col("missing") == F.col("rows")).alias("empty_columns"),
    )
    return MissingAudit(totals, columns)


# -- statistics ------------------------------------------------------------


@dataclass(frozen=True)
class Statistics:
    numeric: DataFrame | None
    categorical: DataFrame | None


def numeric_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, mean, median, std, min, q1, q3, max."""
    names = list(columns or numeric_columns(df))
    measures = {
        "count": lambda c: F.count(col(c)),
        "mean": lambda c: F.avg(col(c).cast("double")),
        "std": lambda c: F.stddev_samp(col(c).cast("double")),
        "min": lambda c: F.min(col(c)).cast("double"),
        "max": lambda c: F.max(col(c)).cast("double"),
    }
    base = {r["column"]: r for r in per_column(df, names, measures).collect()}
    cuts = quantiles(df, names, [0.25, 0.5, 0.75])
    rows = [
        (c, b["count"], b["mean"], q[1], b["std"], b["min"], q[0], q[2], b["max"])
        for c in names
        for b, q in [(base[c], cuts[c])]
    ]
    schema = (
        "column string, count long, mean double, median double, std double, min double, "
        "q1 double, q3 double, max double"
    )
    return local_frame(df.sparkSession, rows, schema)


def categorical_statistics(df: DataFrame, k: int = 5) -> DataFrame:
    """Per text column: distinct values and the ``k`` most frequent with their counts."""
    names = categorical_columns(df)
    counted = value_table(df, names)
    distinct = counted.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    best = top_k_per(counted, ["column"], [F.desc("count"), F.asc("value")], k)
    return best.join(F.broadcast(distinct), "column").select(
        "column", "distinct", "rank", "value", "count"
    )


def generate_statistics(df: DataFrame) -> Statistics:
    numeric = numeric_statistics(df) if numeric_columns(df) else None
    return Statistics(numeric, categorical_statistics(df) if categorical_columns(df) else None)


# -- correlation -----------------------------------------------------------


def _product_means(df: DataFrame, values: Sequence[Column]) -> np.ndarray:
    """Mean of the product of every two columns, by one distributed covariance pass."""
    names = [f"v{i}" for i in range(len(values))]
    wide = df.select(*[v.alias(n) for v, n in zip(values, names)])
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(wide).select("v")
    kind = Summarizer.metrics("mean", "std", "count").summary(F.col("v")).alias("s")
    found = vectors.agg(kind).first()["s"]
    mean, std, n = found["mean"].toArray(), found["std"].toArray(), found["count"]
    corr = np.nan_to_num(MLCorrelation.corr(vectors, "v").first()[0].toArray())
    np.fill_diagonal(corr, 1.0)
    return corr * np.outer(std, std) * ((n - 1) / n) + np.outer(mean, mean)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlation of every two columns over the rows where both have a value.

    Gaps are set to 0 after centring. The sums over complete pairs are then plain products of
    centred values, their squares and presence flags, so one covariance pass serves every
    pair however many there are. Without gaps the centred values suffice.
    """
    doubles = {c: col(c).cast("double") for c in columns}
    base = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(doubles.values())],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(doubles.values())],
        *[F.count(x).alias(f"k{i}") for i, x in enumerate(doubles.values())],
    ).first()
    p = len(columns)
    empty = np.full((p, p), np.nan)
    if base["n"] < 2:
        return empty
    z = [
        F.coalesce((x - F.lit(base[f"m{i}"] or 0.0)) / F.lit(base[f"s{i}"] or 1.0), F.lit(0.0))
        for i, x in enumerate(doubles.values())
    ]
    gapless = all(base[f"k{i}"] == base["n"] for i in range(p))
    if gapless:
        products = _product_means(df, z)
        spread = np.sqrt(np.outer(products.diagonal(), products.diagonal()))
        return np.divide(products, spread, out=empty, where=spread > 1e-12)
    there = [F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in doubles.values()]
    products = _product_means(df, [*z, *[x * x for x in z], *there])
    both = products[2 * p :, 2 * p :]
    sums, squares = products[:p, 2 * p :], products[p : 2 * p, 2 * p :]
    with np.errstate(divide="ignore", invalid="ignore"):
        mx, my = sums / both, sums.T / both
        vx, vy = squares / both - mx * mx, squares.T / both - my * my
        cov = products[:p, :p] / both - mx * my
        corr = cov / np.sqrt(vx * vy)
    enough = (both * base["n"] > 1.5) & (vx > 1e-12) & (vy > 1e-12)
    return np.where(enough, corr, np.nan)


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(a, b, corr)`` of every pair of numeric columns; null where it is not defined."""
    names = list(columns or numeric_columns(df))
    matrix = correlation_matrix(df, names) if len(names) > 1 else None
    rows = [
        (names[i], names[j], _known(matrix[i, j])) for i, j in combinations(range(len(names)), 2)
    ]
    return local_frame(df.sparkSession, rows, "a string, b string, corr double")


def _known(r: float) -> float | None:
    return None if np.isnan(r) else float(min(1.0, max(-1.0, r)))


@dataclass(frozen=True)
class Correlation:
    matrix: DataFrame
    top_pairs: DataFrame


def generate_correlation_matrix(df: DataFrame, k: int = TOP_PAIRS) -> Correlation | None:
    """The matrix in long form (3 places) and the ``k`` strongest pairs; None below 2 columns."""
    names = numeric_columns(df)
    if len(names) < 2:
        return None
    found = correlation_matrix(df, names)
    cells = [
        (a, b, None if np.isnan(found[i, j]) else round(_known(found[i, j]), 3))
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    pairs = [
        (names[i], names[j], _known(found[i, j]))
        for i, j in combinations(range(len(names)), 2)
        if not np.isnan(found[i, j])
    ]
    pairs.sort(key=lambda r: (-abs(r[2]), r[0], r[1]))
    schema = "a string, b string, corr double"
    spark = df.sparkSession
    return Correlation(local_frame(spark, cells, schema), local_frame(spark, pairs[:k], schema))


# -- outliers --------------------------------------------------------------


def iqr_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Bounds at 1.5 interquartile ranges, for columns with enough distinct values."""
    names = [c for c in columns if kinds(df)[c] == NUMERIC]
    distinct = distinct_capped(df, names, OUTLIER_MIN_DISTINCT)
    names = [c for c in names if distinct[c] >= OUTLIER_MIN_DISTINCT]
    found = quantiles(df, names, [0.25, 0.75])
    bounds = {}
    for c in names:
        q1, q3 = found[c]
        reach = IQR_FACTOR * (q3 - q1)
        bounds[c] = (q1 - reach, q3 + reach)
    return bounds


def detect_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column with outliers: how many, their share of the values, and the bounds."""
    bounds = iqr_bounds(df, columns or numeric_columns(df))
    schema = "column string, outliers long, pct double, low double, high double"
    if not bounds:
        return local_frame(df.sparkSession, [], schema)
    measures = {
        "values": lambda c: F.count(col(c)),
        "outliers": lambda c: F.count_if((col(c) < bounds[c][0]) | (col(c) > bounds[c][1])),
        "low": lambda c: F.lit(bounds[c][0]),
        "high": lambda c: F.lit(bounds[c][1]),
    }
    counted = per_column(df, list(bounds), measures).where("outliers > 0")
    pct = F.round(100.0 * F.col("outliers") / F.col("values"), 2)
    return counted.select("column", "outliers", pct.alias("pct"), "low", "high")


# -- roles -----------------------------------------------------------------


def describe_schema(df: DataFrame, sample_values: int = 5) -> DataFrame:
    """Catalogue: kind, missing, distinct, range of numbers, frequent examples of text."""
    base = column_profile(df).drop("rows")
    numeric = numeric_columns(df)
    labels = columns_of(df, CATEGORICAL, BOOLEAN)
    if numeric:
        ends = per_column(
            df, numeric,
            {"min": lambda c: F.min(col(c)).cast("double"), "max": lambda c: F.max(col(c)).cast("double")},
        ).drop("position")
        base = base.join(F.broadcast(ends), "column", "left")
    else:
        base = base.withColumns({e: F.lit(None).cast("double") for e in ("min", "max")})
    if labels:
        ordered = F.sort_array(F.collect_list(F.struct("rank", "value")))
        examples = top_values(df, labels, sample_values).groupBy("column").agg(
            F.transform(ordered, lambda s: s["value"]).alias("examples")
        )
        return base.join(F.broadcast(examples), "column", "left")
    return base.withColumn("examples", F.lit(None).cast("array<string>"))


def suggest_roles(df: DataFrame, dates: bool = True) -> DataFrame:
    """``(column, role)``: dimensions to group by, measures to aggregate, date columns."""
    kind = kinds(df)
    numeric = numeric_columns(df)
    few = distinct_capped(df, numeric, DIMENSION_LIMIT)
    rows = []
    for position, c in enumerate(df.columns):
        if kind[c] in (CATEGORICAL, BOOLEAN) or (c in few and few[c] <= DIMENSION_LIMIT):
            rows.append((position, c, "dimension"))
        if kind[c] == NUMERIC:
            rows.append((position, c, "measure"))
    if dates:
        found = detect_datetime_columns(df)
        rows += [(df.columns.index(c), c, "date") for c in found]
    return local_frame(df.sparkSession, rows, "position int, column string, role string")


@dataclass(frozen=True)
class Balance:
    summary: DataFrame
    counts: DataFrame


def class_balance(df: DataFrame, target: str, k: int = 12) -> Balance:
    """How lopsided a target is: share of its largest class, and the largest counts."""
    name = resolve(df, target, "class_balance")
    counted = df.where(col(name).isNotNull()).groupBy(col(name).alias("value")).count()
    share = F.max("count") / F.sum("count")
    summary = counted.agg(
        F.count(F.lit(1)).alias("classes"),
        F.round(share, 4).alias("largest_share"),
        ((share >= 0.65) & (F.count(F.lit(1)) >= 2)).alias("imbalanced"),
    )
    counts = counted.orderBy(F.desc("count"), F.col("value").cast("string")).limit(k)
    return Balance(summary, counts)


def name_score(column: str) -> int:
    """Evidence from the name alone: +50 for a target word, -100 for an identifier word."""
    lowered = column.lower().strip()
    words = lowered.split()
    score = 0
    if any(h in words or (len(h) >= 4 and h in lowered) for h in TARGET_HINTS):
        score += 50
    if any(h in words or lowered == h for h in ID_HINTS):
        score -= 100
    return score


def _content_score(kind: str, distinct: int, pair: set[str] | None) -> int:
    if kind == BOOLEAN:
        return 45
    if kind == NUMERIC:
        return 10 if distinct > 10 else 5
    if distinct == 2:
        return 55 if pair in BINARY_PAIRS else 40
    if distinct <= 10:
        return 10
    return 5 if distinct <= MAX_CARDINALITY else -60


@dataclass(frozen=True)
class Detection:
    problem_type: str
    target: str | None
    confidence: str
    auto_detected: bool
    candidates: DataFrame


def detect_problem_type(
    df: DataFrame, target: str | None = None, exact: bool = False
) -> Detection:
    """Score every column as a target and derive the task from the best or the given one.

    The scores need distinct counts up to MAX_CARDINALITY only; without ``exact`` the counts
    above that are sketched, which spares shuffling every value of wide-ranging columns.
    """
    if target is not None:
        target = resolve(df, target, "target")
    names = _profilable(df)
    kind = kinds(df)
    distinct = distinct_counts(df, names) if exact else distinct_capped(df, names, MAX_CARDINALITY)
    pairs = _two_values(df, [c for c in names if distinct[c] == 2 and kind[c] == CATEGORICAL])
    rows = []
    for position, c in enumerate(names):
        if distinct[c] == 0:
            continue
        score = name_score(c) + _content_score(kind[c], distinct[c], pairs.get(c))
        regression = kind[c] == NUMERIC and distinct[c] > 5
        task = "regression" if regression else "classification"
        rows.append((position, c, kind[c], distinct[c], score, task))
    ranked = sorted(rows, key=lambda r: (-r[4], r[0]))
    schema = (
        "position int, column string, kind string, distinct long, score int, suggested_task string"
    )
    frame = local_frame(df.sparkSession, ranked, schema)
    if target is not None:
        task = next((r[5] for r in rows if r[1] == target), None)
        if task is None:
            raise ValidationError(f"Target column '{target}' has no values")
        return Detection(task, target, "high", False, frame)
    if not ranked or ranked[0][4] < 20:
        return Detection("clustering", None, "low", False, frame)
    best = ranked[0]
    return Detection(best[5], best[1], "high" if best[4] >= 40 else "medium", True, frame)


def _two_values(df: DataFrame, columns: Sequence[str]) -> dict[str, set[str]]:
    """The two values of two-valued text columns are simply their minimum and maximum."""
    if not columns:
        return {}
    ends = per_column(
        df, columns,
        {"low": lambda c: F.min(F.lower(col(c))), "high": lambda c: F.max(F.lower(col(c)))},
    )
    return {r["column"]: {r["low"], r["high"]} for r in ends.collect()}


def detect_datetime_columns(df: DataFrame, min_success: float = 0.8) -> list[str]:
    """Date columns, and text that nearly always reads as a date, judged on all values."""
    rates = date_parse_rates(df)
    found = []
    for f in df.schema.fields:
        if kind_of(f.dataType) == DATETIME:
            found.append(f.name)
        elif f.name in rates:
            values, rate = rates[f.name]
            hinted = any(h in f.name.lower() for h in DATE_HINTS)
            if values >= MIN_DATED and rate >= (min_success if hinted else 0.95):
                found.append(f.name)
    return found


def date_parse_rates(df: DataFrame) -> dict:
    """``{text column: (values, share that reads as a date)}``, in one aggregation."""
    names = columns_of(df, CATEGORICAL)
    if not names:
        return {}
    rates = per_column(
        df, names,
        {"values": lambda c: F.count(col(c)), "dates": lambda c: F.count(parse_datetime(col(c)))},
    )
    return {
        r["column"]: (r["values"], r["dates"] / r["values"] if r["values"] else 0.0)
        for r in rates.collect()
    }


def identifier_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns that number or name the rows instead of describing them.

    Nearly all values differ, at least 20 of them; numbers must also be whole and dense.
    """
    names = list(columns or _profilable(df))
    kind = kinds(df)
    rows = df.count()
    estimate = distinct_counts(df, names, approximate=True)
    likely = [c for c in names if estimate[c] >= 0.7 * rows and estimate[c] >= 15]
    if not likely:
        return []
    exact = distinct_counts(df, likely)
    wide = [c for c in likely if exact[c] >= max(20, 0.95 * rows)]
    whole = [c for c in wide if kind[c] == NUMERIC]
    dense = set()
    if whole:
        ends = per_column(
            df, whole,
            {
                "low": lambda c: F.min(col(c)).cast("double"),
                "high": lambda c: F.max(col(c)).cast("double"),
                "fraction": lambda c: F.max(F.abs(col(c).cast("double") % 1.0)),
            },
        )
        for r in ends.collect():
            span = r["high"] - r["low"] + 1
            if r["fraction"] == 0 and span <= 1.5 * exact[r["column"]]:
                dense.add(r["column"])
    return [c for c in wide if kind[c] != NUMERIC or c in dense]


def is_identifier(df: DataFrame, column: str) -> bool:
    return bool(identifier_columns(df, [resolve(df, column, "is_identifier")]))


def dashboard_layout(df: DataFrame) -> DataFrame:
    """``(position, column, role)``: measures, dimensions and dates worth showing."""
    names = _profilable(df)
    kind = kinds(df)
    skipped = set(identifier_columns(df, names))
    distinct = distinct_capped(df, names, DASHBOARD_DIMENSION_LIMIT)
    rows = []
    for position, c in enumerate(df.columns):
        if c not in distinct or c in skipped or distinct[c] <= 1:
            continue
        if distinct[c] <= DASHBOARD_DIMENSION_LIMIT:
            rows.append((position, c, "dimension"))
        elif kind[c] == NUMERIC:
            rows.append((position, c, "measure"))
    rows += [(df.columns.index(c), c, "date") for c in detect_datetime_columns(df)]
    return local_frame(df.sparkSession, rows, "position int, column string, role string")


def filter_options(df: DataFrame, dims: Sequence[str], k: int = FILTER_VALUES) -> DataFrame:
    """The ``k`` most frequent values per dimension, and whether there are more."""
    names = [resolve(df, d, "dimensions") for d in dims]
    counted = value_table(df, names)
    sizes = counted.groupBy("column").agg((F.count(F.lit(1)) > k).alias("truncated"))
    best = top_k_per(counted, ["column"], [F.desc("count"), F.asc("value")], k)
    return best.join(F.broadcast(sizes), "column").select(
        "column", "rank", "value", "count", "truncated"
    )


