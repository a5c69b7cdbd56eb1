"""Insights, dashboard tables, feature advice, improvement recipes and the full analysis."""

from granary.operators.query import Filter
from granary.plans import advice, analysis, dashboard, improve, insights
from granary.session import local_frame
from pyspark.sql import functions as F
from workload.registry import GAPS, dates_as_text, query, rounded


@query("insights_of_events")
def _(t):
    return insights.generate_insights(t.events).findings


@query("insights_counted_by_kind")
def _(t):
    return insights.generate_insights(t.gaps()).by_kind


@query(
    "insights_about_gaps",
    f"""
    select "column", round(least(1.5 * pct, 95), 1) as importance from (
      select 'flag' as "column", round(100.0 * count_if(flag is null) / count(*), 2) as pct from {GAPS}
      union all
      select 'quantity', round(100.0 * count_if(quantity is null) / count(*), 2) from {GAPS})
    where pct >= 20
    """,
)
def _(t):
    found = insights.generate_insights(t.gaps(), 100, ["quality"]).findings
    gaps = found.where("kind = 'data_quality' and evidence['missing'] is not null")
    return gaps.select(F.col("columns")[0].alias("column"), "importance")


@query(
    "insights_about_skew",
    """
    with s as (select avg(value) as mu from events),
    k as (select avg((value - mu) ** 3) / power(avg((value - mu) ** 2), 1.5) as skew from events, s)
    select 'value' as "column", round(least(25 * abs(skew), 80), 1) as importance from k
    where abs(skew) >= 1.5
    """,
)
def _(t):
    found = insights.generate_insights(t.events, 100, ["skew"]).findings.where("kind = 'skew'")
    return found.select(F.col("columns")[0].alias("column"), "importance")


@query(
    "dashboard_kpis",
    """
    with e as (select * from events where event_type in ('click', 'view')),
    c as (select event_type, count(*) as n from e group by 1 order by 2 desc, 1 limit 1)
    select 'rows' as tile, count(*)::double as value, null as text from e
    union all select 'rows_total', count(*)::double, null from events
    union all select 'total', round(sum(value), 3), 'value' from e
    union all select 'average', round(avg(value), 3), 'value' from e
    union all select 'median', round(quantile_cont(value, 0.5), 3), 'value' from e
    union all select 'top_category', n::double, event_type from c
    union all select 'top_share_pct', round(100.0 * n / (select count(*) from e), 2), event_type from c
    union all select 'first_date', null, strftime(min(ts), '%Y-%m-%d') from e
    union all select 'last_date', null, strftime(max(ts), '%Y-%m-%d') from e
    union all select 'days', floor(epoch(max(ts) - min(ts)) / 86400)::double, null from e
    """,
)
def _(t):
    filters = [Filter("event_type", "in", ["click", "view"])]
    return rounded(dashboard.dashboard_kpis(t.events, filters, "value", "event_type", "ts"), 3)


@query(
    "dashboard_bars",
    f"select flag as \"group\", round(avg(quantity), 4) as value from {GAPS} group by 1 "
    "order by 2 desc nulls last, 1 limit 12",
)
def _(t):
    return rounded(dashboard.dashboard_bars(t.gaps(), "flag", "quantity"))


@query(
    "dashboard_row_bars",
    "select p_name as \"group\", count(*)::double as value from part group by 1 "
    "order by 2 desc, 1 limit 12",
)
def _(t):
    bars = dashboard.dashboard_bars(t.part, "p_name")
    order = [F.desc("value"), F.asc("group")]
    return bars.orderBy(*order)


@query(
    "dashboard_share",
    f"select flag as value, count(*) as count, "
    f"round(100.0 * count(*) / (select count(*) from {GAPS}), 2) as share_pct from {GAPS} group by 1",
)
def _(t):
    return dashboard.dashboard_share(t.gaps(), "flag")


@query(
    "dashboard_timeline",
    "select strftime(ts, '%Y-%m-%d') as period, round(avg(value), 4) as value from events group by 1",
)
def _(t):
    line = dashboard.dashboard_timeline(t.events, "ts", "value").line
    return rounded(dates_as_text(line.select("period", "value")))


@query(
    "dashboard_cross_means",
    "select o_orderpriority as a, o_orderstatus as b, round(avg(o_totalprice), 4) as value "
    "from orders group by 1, 2",
)
def _(t):
    return rounded(
        dashboard.dashboard_cross(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice")
    )


@query(
    "dashboard_cross_counts",
    """
    with n as (select p_name, p_type, count(*)::double as value from part group by 1, 2)
    select p_name as a, p_type as b, value from n
    where p_name in (select distinct p_name from part order by 1 limit 12)
    """,
)
def _(t):
    return dashboard.dashboard_cross(t.part, "p_name", "p_type")


@query("dashboard_tables")
def _(t):
    made = dashboard.build_dashboard(t.events)
    parts = {
        "kpis": made.kpis, "bars": made.bars, "share": made.share, "options": made.options,
        "distribution": made.distribution, "timeline": made.timeline and made.timeline.line,
    }
    rows = [(name, df.count()) for name, df in parts.items() if df is not None]
    return local_frame(t.spark, rows, "part string, rows long")


@query("feature_advice")
def _(t):
    return advice.screen_features(t.part, "p_retailprice", "regression").columns


@query("feature_advice_measured")
def _(t):
    found = advice.suggest_features(t.part, "p_retailprice", "regression")
    row = (len(found.all_usable), len(found.recommended), found.score_all, found.score_recommended)
    schema = "usable int, recommended int, score_all double, score_recommended double"
    return local_frame(t.spark, [row], schema)


@query("improvement_recipes")
def _(t):
    current = improve.Current(best_model="ridge")
    found = improve.suggest_improvements(
        t.part, "p_retailprice", "regression", current, iterations=3,
        candidates=(("ridge", None), ("decision_tree", None)),
    )
    return found.recipes


@query("full_analysis")
def _(t):
    found = analysis.analyze(t.part)
    parts = {
        "columns": found.profile.columns, "missing": found.missing.columns,
        "numeric": found.statistics.numeric, "categorical": found.statistics.categorical,
        "pairs": found.correlation.top_pairs, "outliers": found.outliers,
        "candidates": found.task.candidates, "preview": found.preview, "boxes": found.boxes,
        "bars": found.bars, "scatter": found.scatter, "target": found.target,
        **{f"histogram_{c}": h for c, h in found.histograms.items()},
    }
    rows = [(name, df.count()) for name, df in parts.items() if df is not None]
    return local_frame(t.spark, rows, "part string, rows long")
