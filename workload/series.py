"""Time series: resampling, gaps, trend, anomalies, change and seasonality."""

from granary.operators.series import (
    endpoints, moving_average, period_change, period_index, seasonality, time_series,
)
from pyspark.sql import functions as F
from workload.registry import QUIET, SPIKED, dates_as_text, query, rounded


def _line(series, digits=2):
    return rounded(dates_as_text(series.line.select("period", "value")), digits)


def _day(expr):
    return f"strftime({expr}, '%Y-%m-%d')"


@query(
    "daily_sum",
    f"select {_day('ts::date')} as period, round(sum(value), 2) as value from events group by 1",
)
def _(t):
    return _line(time_series(t.events, "ts", "value", "sum"))


@query(
    "daily_sum_fills_gaps_with_zero",
    f"""
    with d as (select ts::date as d, sum(value) as v from {QUIET} group by 1),
    c as (select unnest(generate_series((select min(d) from d)::timestamp,
      (select max(d) from d)::timestamp, interval 1 day))::date as d)
    select {_day('c.d')} as period, round(coalesce(v, 0), 2) as value from c left join d on c.d = d.d
    """,
)
def _(t):
    return _line(time_series(t.quiet_days(), "ts", "value", "sum"))


@query(
    "daily_count_fills_gaps_with_zero",
    f"""
    with d as (select ts::date as d, count(*)::double as v from {QUIET} group by 1),
    c as (select unnest(generate_series((select min(d) from d)::timestamp,
      (select max(d) from d)::timestamp, interval 1 day))::date as d)
    select {_day('c.d')} as period, coalesce(v, 0) as value from c left join d on c.d = d.d
    """,
)
def _(t):
    return _line(time_series(t.quiet_days(), "ts"))


@query(
    "daily_mean_leaves_gaps_out",
    f"select {_day('ts::date')} as period, round(avg(value), 2) as value from {QUIET} group by 1",
)
def _(t):
    return _line(time_series(t.quiet_days(), "ts", "value", "mean"))


@query(
    "daily_deviation_needs_two_rows",
    f"select {_day('ts::date')} as period, round(stddev_samp(value), 2) as value from {QUIET} "
    "group by 1 having count(*) > 1",
)
def _(t):
    return _line(time_series(t.quiet_days(), "ts", "value", "std"))


@query(
    "weekly_sum_chosen_automatically",
    f"""
    with w as (select d + ((7 - isodow(d)) % 7)::int as w, sum(v) as v
      from (select o_orderdate::date as d, o_totalprice as v from orders) group by 1),
    c as (select unnest(generate_series((select min(w) from w)::timestamp,
      (select max(w) from w)::timestamp, interval 7 day))::date as w)
    select {_day('c.w')} as period, round(coalesce(v, 0), 2) as value from c left join w on c.w = w.w
    """,
)
def _(t):
    series = time_series(t.orders, "o_orderdate", "o_totalprice", "sum")
    assert series.freq == "W"
    return _line(series)


@query(
    "monthly_median",
    f"select {_day('last_day(o_orderdate::date)')} as period, "
    "round(quantile_cont(o_totalprice, 0.5), 3) as value from orders group by 1",
)
def _(t):
    return _line(time_series(t.orders, "o_orderdate", "o_totalprice", "median", "ME"), 3)


@query(
    "quarterly_maximum",
    """
    select strftime(last_day((date_trunc('quarter', o_orderdate) + interval 2 month)::date),
      '%Y-%m-%d') as period, round(max(o_totalprice), 2) as value from orders group by 1
    """,
)
def _(t):
    return _line(time_series(t.orders, "o_orderdate", "o_totalprice", "max", "QE"))


@query(
    "yearly_distinct_customers",
    """
    select concat(extract(year from o_orderdate)::varchar, '-12-31') as period,
      count(distinct o_custkey)::double as value from orders group by 1
    """,
)
def _(t):
    return _line(time_series(t.orders, "o_orderdate", "o_custkey", "nunique", "YE"))


TREND = """
    with l as (select last_day(o_orderdate::date) as p, sum(o_totalprice) as v from orders group by 1),
    x as (select v, row_number() over (order by p) - 1 as i from l)
"""


@query(
    "linear_trend",
    TREND
    + """
    select count(*)::int as points, round(regr_slope(v, i), 2) as slope_per_period,
      round(regr_intercept(v, i), 2) as intercept, round(regr_r2(v, i), 4) as r_squared from x
    """,
)
def _(t):
    trend = time_series(t.orders, "o_orderdate", "o_totalprice", "sum", "ME").trend
    return trend.select(
        "points", F.round("slope_per_period", 2).alias("slope_per_period"),
        F.round("intercept", 2).alias("intercept"), F.round("r_squared", 4).alias("r_squared"),
    )


@query(
    "anomalies",
    f"""
    with l as (select ts::date as p, sum(value) as v from {SPIKED} group by 1),
    x as (select p, v, row_number() over (order by p) - 1 as i from l),
    f as (select regr_slope(v, i) as b, regr_intercept(v, i) as a from x),
    r as (select p, v, v - (a + b * i) as e from x, f),
    z as (select p, v, e / (select stddev_pop(e) from r) as z from r)
    select {_day('p')} as period, round(v, 2) as value, round(z, 2) as z_score,
      case when z > 0 then 'spike' else 'dip' end as direction from z where abs(z) >= 3
    """,
)
def _(t):
    found = time_series(t.spiked(), "ts", "value", "sum").anomalies
    return rounded(dates_as_text(found), 2)


@query(
    "moving_average_and_change",
    f"""
    with l as (select ts::date as p, sum(value) as v from events group by 1)
    select {_day('p')} as period,
      round(avg(v) over (order by p rows between 6 preceding and current row), 2) as moving_average,
      round(100 * (v - lag(v) over (order by p)) / lag(v) over (order by p), 2) as change_pct
    from l
    """,
)
def _(t):
    points = time_series(t.events, "ts", "value", "sum").points
    return rounded(dates_as_text(points.select("period", "moving_average", "change_pct")), 2)


@query(
    "change_after_zero_is_null",
    f"""
    with d as (select ts::date as d, sum(value) as v from {QUIET} group by 1),
    c as (select unnest(generate_series((select min(d) from d)::timestamp,
      (select max(d) from d)::timestamp, interval 1 day))::date as d),
    l as (select c.d as p, coalesce(v, 0) as v from c left join d on c.d = d.d)
    select {_day('p')} as period, (row_number() over (order by p) - 1)::int as position,
      round(100 * (v - lag(v) over (order by p)) / nullif(lag(v) over (order by p), 0), 2) as change_pct,
      round(avg(v) over (order by p rows between 2 preceding and current row), 2) as moving_average
    from l
    """,
)
def _(t):
    line = time_series(t.quiet_days(), "ts", "value", "sum").line.select("period", "value")
    framed = moving_average(period_change(period_index(line)), 3)
    return rounded(
        dates_as_text(framed.select("period", "position", "change_pct", "moving_average")), 2
    )


@query(
    "endpoints_and_total_change",
    f"""
    with l as (select ts::date as p, sum(value) as v from events group by 1)
    select {_day('min(p)')} as first_period, round(arg_min(v, p), 2) as first_value,
      {_day('max(p)')} as last_period, round(arg_max(v, p), 2) as last_value,
      {_day('arg_max(p, v)')} as peak_period, round(max(v), 2) as peak_value,
      {_day('arg_min(p, v)')} as trough_period, round(min(v), 2) as trough_value,
      round(100 * (arg_max(v, p) - arg_min(v, p)) / abs(arg_min(v, p)), 2) as total_change_pct
    from l
    """,
)
def _(t):
    line = time_series(t.events, "ts", "value", "sum").line
    return rounded(dates_as_text(endpoints(line)), 2)


@query(
    "seasonality_by_month_and_weekday",
    """
    select 'month' as cycle, extract(month from o_orderdate)::int as position,
      strftime(any_value(o_orderdate), '%b') as label, round(avg(o_totalprice), 2) as value
    from orders group by 2
    union all
    select 'weekday', (isodow(o_orderdate) - 1)::int, strftime(any_value(o_orderdate), '%a'),
      round(avg(o_totalprice), 2) from orders group by 2
    """,
)
def _(t):
    return rounded(seasonality(t.orders, "o_orderdate", "o_totalprice", "mean"), 2)


@query(
    "seasonality_by_weekday_only",
    "select 'weekday' as cycle, (isodow(ts) - 1)::int as position, strftime(any_value(ts), '%a') "
    "as label, count(*)::double as value from events group by 2",
)
def _(t):
    return time_series(t.events, "ts").seasonality
