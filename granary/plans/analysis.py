"""The full first look at a table, as named frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from granary.functions.kinds import OTHER, col, kinds, numeric_columns
from granary.operators.profiling import (
    Correlation, Detection, MissingAudit, Profile, Statistics, analyze_dataset,
    detect_missing_values, detect_outliers, detect_problem_type, generate_correlation_matrix,
    generate_statistics,
)
from granary.operators.reshape import (
    bar_counts, box_summary, chart_columns, histogram, missing_pct, scatter_points, target_distribution,
)

from granary.sources.tables import preview


@dataclass(frozen=True)
class Analysis:
    profile: Profile
    missing: MissingAudit
    statistics: Statistics
    correlation: Correlation | None
    outliers: DataFrame
    task: Detection
    preview: DataFrame
    histograms: dict[str, DataFrame]
    boxes: DataFrame | None
    bars: DataFrame
    scatter: DataFrame
    target: DataFrame | None
    missing_chart: DataFrame


def analyze(df: DataFrame, target: str | None = None, scatter_rows: int | None = None) -> Analysis:
    """Profile, gaps, statistics, correlation, outliers, task, preview and chart tables."""
    table = df.select(*[col(c) for c, k in kinds(df).items() if k != OTHER])
    task = detect_problem_type(table, target)
    return Analysis(
        profile=analyze_dataset(table),
        missing=detect_missing_values(table),
        statistics=generate_statistics(table),
        correlation=generate_correlation_matrix(table),
        outliers=detect_outliers(table),
        task=task,
        preview=preview(table),
        histograms={c: histogram(table, c) for c in chart_columns(table)},
        boxes=box_summary(table) if numeric_columns(table) else None,
        bars=bar_counts(table),
        scatter=scatter_points(table, task.target, scatter_rows),
        target=target_distribution(table, task.target) if task.target else None,
        missing_chart=missing_pct(table),
    )
