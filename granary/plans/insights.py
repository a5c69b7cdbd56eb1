"""Ranked findings: what stands out in a table, each with the numbers it rests on."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ValidationError
from granary.functions.kinds import NUMERIC, OTHER, col, kinds
from granary.operators.compare import one_way_anova, skewness
from granary.operators.counts import distinct_capped, value_table
from granary.operators.profiling import (
    detect_datetime_columns, detect_outliers, duplicate_rows, generate_correlation_matrix,
    missing_counts,
)
from granary.operators.quantiles import quantiles
from granary.operators.series import time_series
from granary.session import local_frame

DIMENSION_LIMIT = 15
STRONG_CORR = 0.5
DOMINANT_PCT = 65.0
MISSING_PCT = 20.0
OUTLIER_PCT = 5.0
SKEW_LIMIT = 1.5
SKEW_ROWS = 10
GROUP_ROWS = 8
ETA_FLOOR = 0.02
ALPHA = 0.05

FINDING = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass
class _Table:
    """The frame with the roles its columns play."""

    df: DataFrame
    rows: int
    missing: dict[str, int]
    distinct: dict[str, int]

    @property
    def dimensions(self) -> list[str]:
        return [c for c, n in self.distinct.items() if 2 <= n <= DIMENSION_LIMIT]

    @property
    def measures(self) -> list[str]:
        kind = kinds(self.df)
        return [c for c, n in self.distinct.items() if kind[c] == NUMERIC and n > DIMENSION_LIMIT]


def _finding(kind: str, importance: float, columns: list[str], **evidence) -> tuple:
    shown = {k: str(v) for k, v in evidence.items() if v is not None}
    return kind, round(max(0.0, min(100.0, float(importance))), 1), columns, shown


def _quality(t: _Table) -> list[tuple]:
    found = []
    for c, n in t.missing.items():
        pct = round(100.0 * n / max(t.rows, 1), 2)
        if pct >= MISSING_PCT:
            found.append(_finding("data_quality", min(1.5 * pct, 95), [c], missing=n, pct=pct))
    copies = duplicate_rows(t.df).first()[0]
    if copies:
        pct = 100.0 * copies / t.rows
        found.append(
            _finding("data_quality", min(3 * pct, 90), [], duplicate_rows=copies, pct=round(pct, 2))
        )
    constant = [c for c, n in t.distinct.items() if n <= 1]
    if constant:
        found.append(_finding("data_quality", 40, constant, constant_columns=len(constant)))
    for r in detect_outliers(t.df).collect():
        pct = 100.0 * r["outliers"] / max(t.rows, 1)
        if pct >= OUTLIER_PCT:
            found.append(
                _finding(
                    "outliers", min(4 * pct, 85), [r["column"]],
                    outlier_count=r["outliers"], pct=round(pct, 2),
                )
            )
    return found


def _correlation(t: _Table) -> list[tuple]:
    matrix = generate_correlation_matrix(t.df)
    pairs = matrix.top_pairs.limit(5).collect() if matrix else []
    return [
        _finding("correlation", 100 * abs(r["corr"]), [r["a"], r["b"]], correlation=r["corr"])
        for r in pairs
        if abs(r["corr"]) >= STRONG_CORR
    ]


def _dominance(t: _Table) -> list[tuple]:
    if not t.dimensions:
        return []
    best = F.max(F.struct(F.col("count"), F.col("value")))
    largest = value_table(t.df, t.dimensions).groupBy("column").agg(
        best.alias("best"), F.sum("count").alias("total")
    )
    found = []
    for r in largest.collect():
        share = 100.0 * r["best"]["count"] / r["total"]
        if share >= DOMINANT_PCT:
            found.append(
                _finding(
                    "imbalance", share, [r["column"]], top_value=r["best"]["value"],
                    share_pct=round(share, 2), count=r["best"]["count"], total=r["total"],
                )
            )
    return found


def _segments(t: _Table) -> list[tuple]:
    """One aggregation per dimension covers all measures."""
    found = []
    measures = t.measures
    for d in t.dimensions if measures else []:
        wanted = []
        for i, m in enumerate(measures):
            x = col(m).cast("double")
            wanted += [
                F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}")
            ]
        groups = t.df.where(col(d).isNotNull()).groupBy(col(d).alias("group")).agg(*wanted).collect()
        for i, m in enumerate(measures):
            shown = [g for g in groups if g[f"n{i}"]]
            large = [
                {"count": g[f"n{i}"], "mean": g[f"m{i}"], "variance": g[f"v{i}"]}
                for g in shown
                if g[f"n{i}"] >= GROUP_ROWS
            ]
            if len(large) < 2:
                continue
            outcome = one_way_anova(large)
            p, eta = outcome["p_value"], outcome["eta_squared"]
            if not math.isfinite(p) or p > ALPHA or eta < ETA_FLOOR:
                continue
            ordered = sorted(shown, key=lambda g: g[f"m{i}"])
            found.append(
                _finding(
                    "segment_difference", min(200 * eta, 95), [d, m], p_value=p,
                    eta_squared=round(eta, 4), highest=ordered[-1]["group"],
                    highest_mean=ordered[-1][f"m{i}"], lowest=ordered[0]["group"],
                    lowest_mean=ordered[0][f"m{i}"],
                )
            )
    return found


def _trends(t: _Table) -> list[tuple]:
    dates = detect_datetime_columns(t.df)
    found = []
    for m in t.measures if dates else []:
        try:
            series = time_series(t.df, dates[0], m, "mean")
        except ValueError:
            continue
        fit = series.fit
        if fit.significant and fit.direction != "flat":
            change = series.summary.first()["total_change_pct"]
            r2 = round(fit.r_squared, 4)
            found.append(
                _finding(
                    "trend", min(100 * r2, 95), [dates[0], m], direction=fit.direction,
                    r_squared=r2, p_value=fit.p_value, total_change_pct=change,
                )
            )
        for r in series.anomalies.orderBy("period").collect():
            found.append(
                _finding(
                    "anomaly", min(20 * abs(r["z_score"]), 90), [dates[0], m], period=r["period"],
                    value=r["value"], z_score=r["z_score"], direction=r["direction"],
                )
            )
    return found


def _skew(t: _Table) -> list[tuple]:
    if not t.measures:
        return []
    skewed = [
        r for r in skewness(t.df, t.measures).collect()
        if r["count"] >= SKEW_ROWS and r["skewness"] is not None and abs(r["skewness"]) >= SKEW_LIMIT
    ]
    if not skewed:
        return []
    names = [r["column"] for r in skewed]
    means = t.df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    medians = quantiles(t.df, names, [0.5])
    return [
        _finding(
            "skew", min(25 * abs(r["skewness"]), 80), [r["column"]],
            skew=round(r["skewness"], 3), mean=means[i], median=medians[r["column"]][0],
        )
        for i, r in enumerate(skewed)
    ]


SCANNERS: tuple[Callable[[_Table], list[tuple]], ...] = (
    _quality, _correlation, _dominance, _segments, _trends, _skew,
)


@dataclass(frozen=True)
class Insights:
    """``findings`` is ranked and capped; ``by_kind`` counts all of them."""

    findings: DataFrame
    by_kind: DataFrame
    skipped: list[str]


def generate_insights(
    df: DataFrame, limit: int = 12, scanners: Sequence[str] | None = None
) -> Insights:
    """Everything noteworthy, most important first. A scanner that fails is skipped.

    All columns are scanned; ``limit`` caps the ranked result only. ``scanners`` picks some of
    quality, correlation, dominance, segments, trends and skew.
    """
    named = {scan.__name__.strip("_"): scan for scan in SCANNERS}
    unknown = [s for s in scanners or () if s not in named]
    if unknown:
        raise ValidationError(f"No scanners {unknown}; there are {list(named)}")
    names = [c for c, k in kinds(df).items() if k != OTHER]
    table = df.select(*[col(c) for c in names])
    gaps = missing_counts(table).collect()
    described = _Table(
        table,
        gaps[0]["rows"],
        {r["column"]: r["missing"] for r in gaps if r["missing"]},
        distinct_capped(table, names, DIMENSION_LIMIT),
    )
    found, skipped = [], []
    for name in scanners or named:
        try:
            found += named[name](described)
        except Exception:  # noqa: BLE001 - one failing scanner must not cost the others
            skipped.append(name)
    ranked = sorted(found, key=lambda f: (-f[1], f[0], f[2]))
    spark = df.sparkSession
    by_kind = local_frame(spark, found, FINDING).groupBy("kind").count()
    return Insights(local_frame(spark, ranked[:limit], FINDING), by_kind, skipped)
