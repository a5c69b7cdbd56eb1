"""Group comparison, rank tests, chi-square tests, skewness and mutual information."""

from granary.operators.compare import (
    compare_segments, leaky_columns, mutual_information, rank_sums, skewness,
)
from granary.session import local_frame
from pyspark.sql import functions as F
from workload.registry import LABELLED, query, rounded

MOMENTS = (
    "count(*)::double as n, avg({x}) as m, var_samp({x}) as v"
)
RANKS = """
    r as (select g, x, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as r
      from d)
"""


@query(
    "segment_summary",
    """
    select c_mktsegment as "group", count(*) as count, round(avg(c_acctbal), 4) as mean,
      round(quantile_cont(c_acctbal, 0.5), 4) as median, round(stddev_samp(c_acctbal), 4) as std,
      min(c_acctbal) as min, max(c_acctbal) as max
    from customer group by 1
    """,
)
def _(t):
    return rounded(compare_segments(t.customer, "c_mktsegment", "c_acctbal").segments)


@query(
    "welch_t_and_cohens_d",
    f"""
    with s as (select l_linestatus as g, {MOMENTS.format(x='l_extendedprice')} from lineitem group by 1),
    p as (select a.n as n1, a.m as m1, a.v as v1, b.n as n2, b.m as m2, b.v as v2
      from s a, s b where a.g = 'F' and b.g = 'O')
    select 'Welch t-test' as name, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) as statistic,
      round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 4) as effect_size,
      round(abs(m1 - m2), 4) as gap from p
    """,
)
def _(t):
    test = compare_segments(t.lineitem, "l_linestatus", "l_extendedprice").test
    return rounded(test.select("name", "statistic", "effect_size", "gap"))


@query(
    "one_way_anova",
    f"""
    with s as (select c_mktsegment as g, {MOMENTS.format(x='c_acctbal')} from customer group by 1),
    q as (select sum(n) as n, count(*)::double as k, sum(n * m) / sum(n) as grand from s),
    b as (select sum(s.n * (m - grand) ** 2) as between_, sum((s.n - 1) * v) as within_ from s, q)
    select 'One-way ANOVA' as name, round((between_ / (k - 1)) / (within_ / (n - k)), 4) as statistic,
      round(between_ / (between_ + within_), 4) as effect_size from b, q
    """,
)
def _(t):
    test = compare_segments(t.customer, "c_mktsegment", "c_acctbal").test
    return rounded(test.select("name", "statistic", "effect_size"))


@query(
    "rank_sums",
    f"""
    with d as (select l_linestatus as g, l_quantity as x from lineitem), {RANKS}
    select g as "group", count(*) as count, sum(r) as rank_sum from r group by 1
    """,
)
def _(t):
    return rank_sums(t.lineitem, "l_linestatus", "l_quantity").select("group", "count", "rank_sum")


@query(
    "mann_whitney_u",
    f"""
    with d as (select l_linestatus as g, l_extendedprice as x from lineitem), {RANKS}
    select 'Mann-Whitney U' as rank_name,
      round(sum(case when g = 'F' then r end)
        - count(case when g = 'F' then 1 end) * (count(case when g = 'F' then 1 end) + 1) / 2.0, 1)
        as rank_statistic from r
    """,
)
def _(t):
    test = compare_segments(t.lineitem, "l_linestatus", "l_extendedprice").test
    return rounded(test.select("rank_name", "rank_statistic"), 1)


@query(
    "kruskal_wallis",
    f"""
    with d as (select l_returnflag as g, l_quantity as x from lineitem), {RANKS},
    s as (select g, count(*)::double as n, sum(r) as r from r group by 1),
    t as (select sum(c * c * c - c) as ties from (select count(*)::double as c from d group by x)),
    q as (select sum(n) as n, sum(r * r / n) as h from s)
    select 'Kruskal-Wallis' as rank_name,
      round((12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) as rank_statistic
    from q, t
    """,
)
def _(t):
    test = compare_segments(t.lineitem, "l_returnflag", "l_quantity").test
    return rounded(test.select("rank_name", "rank_statistic"))


@query(
    "equal_shares_chi_square",
    """
    with s as (select o_orderpriority, count(*)::double as n from orders group by 1),
    e as (select sum(n) / count(*) as e from s)
    select 'Chi-square goodness of fit' as name, round(sum((n - e) ** 2 / e), 4) as statistic,
      round(any_value(e), 2) as expected_per_group from s, e
    """,
)
def _(t):
    test = compare_segments(t.orders, "o_orderpriority").test
    return rounded(test.select("name", "statistic", "expected_per_group"))


@query(
    "segment_shares",
    """
    select o_orderpriority as "group", count(*) as count,
      round(100.0 * count(*) / (select count(*) from orders), 2) as share_pct from orders group by 1
    """,
)
def _(t):
    return compare_segments(t.orders, "o_orderpriority").segments


@query(
    "independence_chi_square",
    """
    with c as (select o_orderstatus as a, o_orderpriority as b, count(*)::double as o
      from orders group by 1, 2),
    e as (select o, sum(o) over (partition by a) * sum(o) over (partition by b) / sum(o) over () as e
      from c),
    x as (select sum((o - e) ** 2 / e) as chi, sum(o) as n from e)
    select round(chi, 4) as statistic, 8 as dof, round(sqrt(chi / n / 2), 4) as cramers_v from x
    """,
)
def _(t):
    test = compare_segments(t.orders, "o_orderstatus", "o_orderpriority").test
    return rounded(test.select("statistic", "dof", "cramers_v"))


@query(
    "independence_with_yates_correction",
    """
    with c as (select quality as a, toxic as b, count(*)::double as o from labels group by 1, 2),
    e as (select o, sum(o) over (partition by a) * sum(o) over (partition by b) / sum(o) over () as e
      from c),
    x as (select sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e) as chi, sum(o) as n from e)
    select round(chi, 4) as statistic, 1 as dof, round(sqrt(chi / n), 4) as cramers_v from x
    """,
)
def _(t):
    df = t.labels.select("quality", F.col("toxic").cast("string").alias("toxic"))
    test = compare_segments(df, "quality", "toxic").test
    return rounded(test.select("statistic", "dof", "cramers_v"))


@query(
    "population_skewness",
    """
    with m as (select 'value' as "column", value as x from events
      union all select 'user_id', user_id::double from events),
    s as (select "column", avg(x) as mu from m group by 1)
    select "column", count(*) as count,
      round(avg((x - mu) ** 3) / power(avg((x - mu) ** 2), 1.5), 4) as skewness
    from m join s using ("column") group by 1
    """,
)
def _(t):
    return rounded(skewness(t.events, ["value", "user_id"]))


def _mi_sql(table, columns, y):
    parts = " union all ".join(
        f"select '{c}' as \"column\", {c}::varchar as x, {y}::varchar as y from {table}" for c in columns
    )
    return f"""
    with m as ({parts}),
    j as (select "column", x, y, count(*)::double as c from m group by 1, 2, 3),
    p as (select "column", c, sum(c) over (partition by "column", x) as cx,
      sum(c) over (partition by "column", y) as cy, sum(c) over (partition by "column") as n from j)
    select "column", round(sum(c / n * ln(c * n / (cx * cy))), 6) as mutual_information
    from p group by 1
    """


@query("mutual_information_of_codes", _mi_sql(LABELLED, ("lang", "source", "toxic"), "quality"))
def _(t):
    found = mutual_information(
        t.labelled(), ["lang", "source", "toxic"], "quality", "classification"
    )
    return rounded(found, 6)


@query("mutual_information_of_flags", _mi_sql("lineitem", ("l_linestatus", "l_linenumber"), "l_returnflag"))
def _(t):
    columns = ["l_linestatus", "l_linenumber"]
    return rounded(mutual_information(t.lineitem, columns, "l_returnflag", "classification"), 6)


@query("mutual_information_of_measures")
def _(t):
    columns = ["l_quantity", "l_discount", "l_returnflag"]
    return rounded(mutual_information(t.lineitem, columns, "l_extendedprice", "regression"), 6)


@query(
    "leaky_columns",
    """
    select "column" from (
      select 'twice' as "column", abs(corr(2 * p_retailprice + 1, p_retailprice)) as r from part
      union all select 'p_size', abs(corr(p_size, p_retailprice)) from part
      union all select 'p_partkey', abs(corr(p_partkey, p_retailprice)) from part)
    where r >= 0.98
    """,
)
def _(t):
    df = t.part.withColumn("twice", 2 * F.col("p_retailprice") + 1)
    found = leaky_columns(df, ["twice", "p_size", "p_partkey"], "p_retailprice")
    return local_frame(t.spark, [(c,) for c in found], "column string")
