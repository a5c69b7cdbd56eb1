"""The tables behind a dashboard: tiles, bars, shares, a timeline and a heat map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.dates import as_datetime
from granary.functions.kinds import col, require_numeric, resolve
from granary.operators.counts import value_counts
from granary.operators.profiling import dashboard_layout, filter_options
from granary.operators.quantiles import quantiles
from granary.operators.query import Filter, apply_filters
from granary.operators.reshape import crosstab_cells, histogram, pivot_cells
from granary.operators.series import TimeSeries, time_series
from granary.session import local_frame

MAX_BARS = 12


def dashboard_kpis(
    df: DataFrame, filters: Sequence[Filter] = (), measure: str | None = None,
    dimension: str | None = None, date: str | None = None,
) -> DataFrame:
    """``(tile, value, text)``: rows, total, average, median, top category, date range."""
    shown = apply_filters(df, filters)
    rows_total = df.count() if filters else None
    wanted = [F.count(F.lit(1)).alias("rows")]
    if measure is not None:
        measure = resolve(df, measure, "measure")
        require_numeric(df, measure, "an average")
        x = col(measure).cast("double")
        wanted += [F.count(x).alias("values"), F.sum(x).alias("total"), F.avg(x).alias("mean")]
    if date is not None:
        when = as_datetime(df, resolve(df, date, "date column"))
        wanted += [F.min(when).alias("first"), F.max(when).alias("last")]
    base = shown.agg(*wanted).first()
    tiles = [("rows", float(base["rows"]), None)]
    tiles.append(("rows_total", float(base["rows"] if rows_total is None else rows_total), None))
    if measure is not None and base["values"]:
        median = quantiles(shown, [measure], [0.5])[measure][0]
        tiles += [
            ("total", base["total"], measure), ("average", base["mean"], measure),
            ("median", median, measure),
        ]
    if dimension is not None:
        top = value_counts(shown, resolve(df, dimension, "dimension"), 1).first()
        if top is not None:
            tiles.append(("top_category", float(top["count"]), str(top["value"])))
            tiles.append(("top_share_pct", top["share_pct"], str(top["value"])))
    if date is not None and base["first"] is not None:
        tiles.append(("first_date", None, str(base["first"].date())))
        tiles.append(("last_date", None, str(base["last"].date())))
        tiles.append(("days", float((base["last"] - base["first"]).days), None))
    return local_frame(df.sparkSession, tiles, "tile string, value double, text string")


def dashboard_bars(df: DataFrame, dimension: str, measure: str | None = None) -> DataFrame:
    """Mean of the measure, or rows, per value of the dimension; nulls are a bar too."""
    name = resolve(df, dimension, "dimension")
    height = F.count(F.lit(1)).cast("double")
    if measure is not None:
        height = F.avg(col(resolve(df, measure, "measure")).cast("double"))
    bars = df.groupBy(col(name).alias("group")).agg(height.alias("value"))
    return bars.orderBy(F.col("value").desc_nulls_last(), F.col("group").asc_nulls_last()).limit(
        MAX_BARS
    )


def dashboard_share(df: DataFrame, dimension: str) -> DataFrame:
    """Rows and share of the largest slices; nulls are a slice too."""
    return value_counts(df, dimension, MAX_BARS, keep_null=True)


def dashboard_timeline(df: DataFrame, date: str, measure: str | None = None) -> TimeSeries:
    """Mean of the measure, or rows, per automatic period."""
    return time_series(df, date, measure, "mean" if measure else "sum")


def dashboard_cross(
    df: DataFrame, a: str, b: str, measure: str | None = None, side: int = MAX_BARS
) -> DataFrame:
    """``(a, b, value)`` of the first ``side`` values each way, in key order."""
    a, b = resolve(df, a, "dimension"), resolve(df, b, "dimension")
    both = df.where(col(a).isNotNull() & col(b).isNotNull())
    if measure is None:
        cells = crosstab_cells(both, a, b)
    else:
        cells = pivot_cells(both, a, b, measure, "mean")
    rows = [(r[a], r[b], r["value"]) for r in cells.collect()]
    down = sorted({r[0] for r in rows})[:side]
    across = sorted({r[1] for r in rows})[:side]
    kept = [
        (str(x), str(y), None if v is None else float(v))
        for x, y, v in rows if x in down and y in across
    ]
    return local_frame(df.sparkSession, kept, "a string, b string, value double")


@dataclass(frozen=True)
class Dashboard:
    layout: DataFrame
    measure: str | None
    dimension: str | None
    date: str | None
    kpis: DataFrame
    bars: DataFrame | None
    share: DataFrame | None
    distribution: DataFrame | None
    timeline: TimeSeries | None
    cross: DataFrame | None
    options: DataFrame | None


def build_dashboard(
    df: DataFrame, filters: Sequence[Filter] = (), measure: str | None = None,
    dimension: str | None = None, date: str | None = None,
) -> Dashboard:
    """Choose columns by their roles, filter, and compute every tile and chart table."""
    layout = dashboard_layout(df)
    roles: dict[str, list[str]] = {"measure": [], "dimension": [], "date": []}
    for r in layout.orderBy("position").collect():
        roles[r["role"]].append(r["column"])

    def pick(given, role):
        return resolve(df, given, role) if given else next(iter(roles[role]), None)

    measure, dimension, date = (
        pick(measure, "measure"), pick(dimension, "dimension"), pick(date, "date")
    )
    shown = apply_filters(df, filters)
    kpis = dashboard_kpis(df, filters, measure, dimension, date)
    empty = kpis.where("tile = 'rows' and value = 0").count() > 0
    timeline = None
    if date and not empty:
        try:
            timeline = dashboard_timeline(shown, date, measure)
        except ValueError:
            timeline = None
    other = next((d for d in roles["dimension"] if d != dimension), None)
    has_bars = dimension is not None and not empty
    return Dashboard(
        layout, measure, dimension, date, kpis,
        dashboard_bars(shown, dimension, measure) if has_bars else None,
        dashboard_share(shown, dimension) if has_bars else None,
        histogram(shown, measure) if measure and not empty else None,
        timeline,
        dashboard_cross(shown, dimension, other, measure) if has_bars and other else None,
        filter_options(df, roles["dimension"]) if roles["dimension"] else None,
    )
