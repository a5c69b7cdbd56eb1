"""Pivots, cross-tabs, histograms and chart tables."""

from granary.operators import reshape
from granary.operators.counts import value_counts
from granary.session import local_frame
from workload.registry import GAPS, query, rounded



def _histogram_sql(table, x):
    return f"""
    with e as (select min({x})::double as lo, max({x})::double as hi from {table}),
    b as (select least(cast(floor(({x} - lo) * 30 / (hi - lo)) as int) + 1, 30) as bin,
          count(*) as n from {table}, e where {x} is not null group by 1)
    select cast(i as int) as bin, round(lo + (i - 1) * (hi - lo) / 30, 4) as low,
      round(lo + i * (hi - lo) / 30, 4) as high, coalesce(n, 0) as count
    from range(1, 31) r(i) cross join e left join b on b.bin = r.i
    """


@query(
    "pivot_sum",
    "select l_returnflag, round(sum(case when l_linestatus = 'F' then l_quantity end), 2) as F, "
    "round(sum(case when l_linestatus = 'O' then l_quantity end), 2) as O from lineitem group by 1",
)
def _(t):
    return rounded(
        reshape.pivot_table(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity", "sum"), 2
    )


@query(
    "pivot_median",
    """
    select o_orderpriority,
      round(quantile_cont(case when o_orderstatus = 'F' then o_totalprice end, 0.5), 4) as F,
      round(quantile_cont(case when o_orderstatus = 'O' then o_totalprice end, 0.5), 4) as O,
      round(quantile_cont(case when o_orderstatus = 'P' then o_totalprice end, 0.5), 4) as P
    from orders group by 1
    """,
)
def _(t):
    return rounded(
        reshape.pivot_table(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "median")
    )


@query(
    "pivot_empty_cells_stay_null",
    """
    select p_brand, max(case when p_name = 'blue bolt' then p_retailprice end) as "blue bolt",
      max(case when p_name = 'red gear' then p_retailprice end) as "red gear"
    from part group by 1
    """,
)
def _(t):
    grid = reshape.pivot_table(t.part, "p_brand", "p_name", "p_retailprice", "max")
    return grid.select("p_brand", "blue bolt", "red gear")


@query(
    "pivot_cells_text_maximum",
    "select o_orderpriority, o_orderstatus, max(o_orderdate) as value from orders group by 1, 2",
)
def _(t):
    return reshape.pivot_cells(t.orders, "o_orderpriority", "o_orderstatus", "o_orderdate", "max")


@query(
    "crosstab_counts",
    """
    select o_orderpriority, count(case when o_orderstatus = 'F' then 1 end) as F,
      count(case when o_orderstatus = 'O' then 1 end) as O,
      count(case when o_orderstatus = 'P' then 1 end) as P
    from orders group by 1
    """,
)
def _(t):
    return reshape.crosstab(t.orders, "o_orderpriority", "o_orderstatus")


@query(
    "value_counts_with_share",
    "select event_type as value, count(*) as count, "
    "round(100.0 * count(*) / sum(count(*)) over (), 2) as share_pct from events group by 1",
)
def _(t):
    return value_counts(t.events, "event_type")


@query(
    "value_counts_top",
    """
    select p_name as value, count(*) as count,
      round(100.0 * count(*) / (select count(*) from part), 2) as share_pct
    from part group by 1 order by 2 desc, 1 limit 12
    """,
)
def _(t):
    return value_counts(t.part, "p_name", 12)


@query("histogram_of_values", _histogram_sql("events", "value"))
def _(t):
    return rounded(reshape.histogram(t.events, "value"))


@query(
    "box_summary_standardised",
    """
    with m as (
      select 'p_partkey' as "column", p_partkey::double as x from part
      union all select 'p_size', p_size::double from part
      union all select 'p_retailprice', p_retailprice from part),
    s as (select "column", avg(x) as mu, stddev_pop(x) as sd, min(x) as lo, max(x) as hi,
      quantile_cont(x, [0.25, 0.5, 0.75]) as q from m group by 1)
    select "column", round((lo - mu) / sd, 4) as min, round((q[1] - mu) / sd, 4) as q1,
      round((q[2] - mu) / sd, 4) as median, round((q[3] - mu) / sd, 4) as q3,
      round((hi - mu) / sd, 4) as max
    from s
    """,
)
def _(t):
    return rounded(reshape.box_summary(t.part))


@query(
    "missing_pct_by_column",
    f"""
    select * from (
      select 'quantity' as "column", round(100.0 * count_if(quantity is null) / count(*), 2) as pct
      from {GAPS}
      union all
      select 'flag', round(100.0 * count_if(flag is null) / count(*), 2) from {GAPS})
    """,
)
def _(t):
    return reshape.missing_pct(t.gaps())


@query("target_distribution_numeric", _histogram_sql("part", "p_retailprice"))
def _(t):
    return rounded(reshape.target_distribution(t.part, "p_retailprice"))


@query(
    "target_distribution_classes",
    "select cast(quality as varchar) as value, count(*) as count from labels group by 1",
)
def _(t):
    return reshape.target_distribution(t.labels, "quality")


@query(
    "scatter_best_columns",
    """
    select x_column, y_column, round(r, 4) as r from (
      select 'p_partkey' as x_column, 'p_retailprice' as y_column,
        corr(p_partkey, p_retailprice) as r from part
      union all select 'p_size', 'p_retailprice', corr(p_size, p_retailprice) from part)
    """,
)
def _(t):
    pairs = reshape.scatter_pairs(t.part, "p_retailprice")
    return rounded(local_frame(t.spark, pairs, "x_column string, y_column string, r double"))


@query(
    "scatter_points_of_best_pair",
    """
    select 'p_partkey' as x_column, 'p_retailprice' as y_column, p_partkey::double as x,
      p_retailprice as y from part
    """,
)
def _(t):
    return reshape.scatter_points(t.part).select("x_column", "y_column", "x", "y")


@query(
    "bar_counts_of_text",
    """
    with m as (select 'l_returnflag' as "column", l_returnflag as value from lineitem
      union all select 'l_linestatus', l_linestatus from lineitem),
    c as (select "column", value, count(*) as count from m group by 1, 2)
    select "column", cast(row_number() over (partition by "column" order by count desc, value) as int)
      as rank, value, count from c
    """,
)
def _(t):
    return reshape.bar_counts(t.lineitem)
