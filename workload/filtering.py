"""Filters, projections, grouping, sorting and limits."""

from granary.operators.query import (
    Aggregation, Filter, QuerySpec, apply_filters, drop_duplicate_rows, run_query, sample_rows,
)
from granary.functions.kinds import drop_null_rows
from granary.operators.counts import top_k, top_k_per
from granary.operators.quantiles import quantile_table
from granary.session import local_frame
from pyspark.sql import functions as F
from workload.registry import COPIES, GAPS, query, rounded

COUNT = Aggregation(alias="rows")


def _totals(df, *filters, column="l_extendedprice"):
    spec = QuerySpec(
        filters=filters, aggregations=[COUNT, Aggregation(column, "sum", "total")]
    )
    return rounded(run_query(df, spec)[0], 2)


def _sql(where, table="lineitem", column="l_extendedprice"):
    return (
        f"select count(*) as rows, round(sum({column}), 2) as total from {table} where {where} "
        "having count(*) > 0"
    )


@query("filter_equals_number", _sql("l_quantity = 25"))
def _(t):
    return _totals(t.lineitem, Filter("l_quantity", "=", 25))


@query("filter_equals_text", _sql("l_returnflag = 'R'"))
def _(t):
    return _totals(t.lineitem, Filter("L_RETURNFLAG", "=", "R"))


@query("filter_equals_date", _sql("l_shipdate = timestamp '1995-08-09'"))
def _(t):
    return _totals(t.lineitem, Filter("l_shipdate", "=", "1995-08-09"))


@query("filter_not_equals_keeps_nulls", _sql("quantity is distinct from 25", GAPS, "price"))
def _(t):
    return _totals(t.gaps(), Filter("quantity", "!=", 25), column="price")


@query("filter_greater", _sql("l_discount > 0.05"))
def _(t):
    return _totals(t.lineitem, Filter("l_discount", ">", "0.05"))


@query("filter_at_least", _sql("l_extendedprice >= 90000"))
def _(t):
    return _totals(t.lineitem, Filter("l_extendedprice", ">=", 90000))


@query("filter_less", _sql("l_shipdate < timestamp '1997-03-01'"))
def _(t):
    return _totals(t.lineitem, Filter("l_shipdate", "<", "1997-03-01"))


@query("filter_at_most", _sql("l_tax <= 0.02"))
def _(t):
    return _totals(t.lineitem, Filter("l_tax", "<=", 0.02))


@query("filter_in", _sql("l_linenumber in (1, 3, 5)"))
def _(t):
    return _totals(t.lineitem, Filter("l_linenumber", "in", [1, 3, 5]))


@query("filter_in_scalar", _sql("l_returnflag = 'A'"))
def _(t):
    return _totals(t.lineitem, Filter("l_returnflag", "in", "A"))


@query("filter_not_in_keeps_nulls", _sql("flag is null or flag not in ('A', 'N')", GAPS, "price"))
def _(t):
    return _totals(t.gaps(), Filter("flag", "not_in", ["A", "N"]), column="price")


@query(
    "filter_contains_pattern",
    _sql("regexp_matches(lower(p_type), 'promo|^st.*d')", "part", "p_retailprice"),
)
def _(t):
    return _totals(t.part, Filter("p_type", "contains", "Promo|^ST.*D"), column="p_retailprice")


@query("filter_between_numbers", _sql("l_quantity between 10 and 20"))
def _(t):
    return _totals(t.lineitem, Filter("l_quantity", "between", [10, 20]))


@query(
    "filter_between_dates",
    _sql("ts between timestamp '2024-01-05' and timestamp '2024-01-12 06:00:00'", "events", "value"),
)
def _(t):
    span = ["2024-01-05", "2024-01-12 06:00:00"]
    return _totals(t.events, Filter("ts", "between", span), column="value")


@query("filter_is_null", _sql("flag is null", GAPS, "price"))
def _(t):
    return _totals(t.gaps(), Filter("flag", "is_null"), column="price")


@query("filter_not_null", _sql("quantity is not null", GAPS, "price"))
def _(t):
    return _totals(t.gaps(), Filter("quantity", "not_null"), column="price")


@query(
    "filters_all_hold",
    _sql("l_returnflag <> 'R' and l_quantity > 30 and l_shipdate >= timestamp '1998-01-01'"),
)
def _(t):
    return _totals(
        t.lineitem, Filter("l_returnflag", "!=", "R"), Filter("l_quantity", ">", 30),
        Filter("l_shipdate", ">=", "1998-01-01"),
    )


@query("filter_nothing_matches", _sql("l_quantity > 1000"))
def _(t):
    return _totals(t.lineitem, Filter("l_quantity", ">", 1000))


@query(
    "drop_null_rows",
    f"select count(*) as rows from {GAPS} where quantity is not null and flag is not null",
)
def _(t):
    return drop_null_rows(t.gaps(), ["quantity", "flag"]).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "select_sorted_limit",
    "select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_discount >= 0.09 "
    "order by l_extendedprice desc nulls last, l_orderkey, l_linenumber limit 1000",
)
def _(t):
    spec = QuerySpec(
        filters=[Filter("l_discount", ">=", 0.09)],
        select=["l_orderkey", "l_linenumber", "l_extendedprice"],
        sort_by="l_extendedprice", limit=5000,
    )
    return run_query(t.lineitem, spec)[0]


@query(
    "select_nulls_last_ascending",
    f"select flag, l_orderkey, l_linenumber, quantity from {GAPS} where price > 104000 "
    "order by flag asc nulls last, l_orderkey nulls last, l_linenumber, quantity nulls last limit 1000",
)
def _(t):
    spec = QuerySpec(
        filters=[Filter("price", ">", 104000)],
        select=["flag", "l_orderkey", "l_linenumber", "quantity"],
        sort_by="flag", ascending=True, limit=1000,
    )
    return run_query(t.gaps(), spec)[0]


@query(
    "group_mean_highest_first",
    "select event_type, round(avg(value), 4) as mean_value from events group by event_type "
    "order by 2 desc limit 25",
)
def group_mean(t):
    spec = QuerySpec(group_by=["event_type"], aggregations=[Aggregation("value", "mean")])
    return rounded(run_query(t.events, spec)[0])


@query(
    "group_all_functions",
    """
    select l_returnflag, l_linestatus, count(*) as row_count,
      count(l_quantity) as count_l_quantity,
      round(sum(l_quantity), 4) as sum_l_quantity,
      round(avg(l_extendedprice), 4) as mean_l_extendedprice,
      round(quantile_cont(l_extendedprice, 0.5), 4) as median_l_extendedprice,
      min(l_discount) as min_l_discount, max(l_tax) as max_l_tax,
      round(stddev_samp(l_quantity), 4) as std_l_quantity,
      count(distinct l_suppkey) as nunique_l_suppkey
    from lineitem group by 1, 2
    """,
)
def _(t):
    aggs = [
        Aggregation(), Aggregation("l_quantity", "count"), Aggregation("l_quantity", "sum"),
        Aggregation("l_extendedprice", "mean"), Aggregation("l_extendedprice", "median"),
        Aggregation("l_discount", "min"), Aggregation("l_tax", "max"),
        Aggregation("l_quantity", "std"), Aggregation("l_suppkey", "nunique"),
    ]
    spec = QuerySpec(group_by=["l_returnflag", "l_linestatus"], aggregations=aggs)
    return rounded(run_query(t.lineitem, spec)[0])


@query(
    "group_null_key_is_a_group",
    f"select flag, count(*) as rows, count(quantity) as known, "
    f"round(coalesce(sum(quantity), 0), 2) as total from {GAPS} group by flag",
)
def _(t):
    aggs = [COUNT, Aggregation("quantity", "count", "known"), Aggregation("quantity", "sum", "total")]
    return rounded(run_query(t.gaps(), QuerySpec(group_by=["flag"], aggregations=aggs))[0], 2)


@query(
    "group_sum_of_nothing_is_zero",
    f"select l_linenumber, cast(coalesce(sum(quantity), 0) as double) as total from {GAPS} "
    "group by 1",
)
def _(t):
    spec = QuerySpec(
        group_by=["l_linenumber"], aggregations=[Aggregation("quantity", "sum", "total")]
    )
    return run_query(t.gaps(), spec)[0]


@query(
    "group_rows_by_default",
    "select o_orderstatus, o_orderpriority, count(*) as row_count from orders group by 1, 2",
)
def _(t):
    return run_query(t.orders, QuerySpec(group_by=["o_orderstatus", "o_orderpriority"]))[0]


@query(
    "group_text_extremes",
    "select p_brand, min(p_name) as min_p_name, max(p_type) as max_p_type from part "
    "group by 1 order by 2 desc, 1 limit 10",
)
def _(t):
    aggs = [Aggregation("p_name", "min"), Aggregation("p_type", "max")]
    return run_query(t.part, QuerySpec(group_by=["p_brand"], aggregations=aggs, limit=10))[0]


@query(
    "group_sorted_by_key",
    "select l_linenumber, round(avg(l_quantity), 4) as mean_l_quantity from lineitem group by 1 "
    "order by l_linenumber limit 5",
)
def _(t):
    spec = QuerySpec(
        group_by=["l_linenumber"], aggregations=[Aggregation("l_quantity", "mean")],
        sort_by="l_linenumber", ascending=True, limit=5,
    )
    return rounded(run_query(t.lineitem, spec)[0])


@query(
    "aggregate_whole_table",
    """
    select count(*) as row_count, round(sum(o_totalprice), 2) as total,
      round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.5), 4) as median,
      count(distinct o_custkey) as customers, min(o_orderpriority) as first_priority
    from orders
    """,
)
def _(t):
    aggs = [
        Aggregation(), Aggregation("o_totalprice", "sum", "total"),
        Aggregation("o_totalprice", "mean", "mean"), Aggregation("o_totalprice", "median", "median"),
        Aggregation("o_custkey", "nunique", "customers"),
        Aggregation("o_orderpriority", "min", "first_priority"),
    ]
    out = run_query(t.orders, QuerySpec(aggregations=aggs))[0]
    return out.withColumns({c: F.round(c, d) for c, d in (("total", 2), ("mean", 4), ("median", 4))})


@query(
    "query_row_counts",
    """
    select count(*) as row_count, sum(n)::bigint as rows_after_filter, count(*) > 5 as truncated
    from (select l_linenumber, count(*) as n from lineitem where l_quantity > 10 group by 1)
    """,
)
def _(t):
    spec = QuerySpec(filters=[Filter("l_quantity", ">", 10)], group_by=["l_linenumber"], limit=5)
    _, meta = run_query(t.lineitem, spec)
    row = (meta.row_count, meta.rows_after_filter, meta.truncated)
    schema = "row_count long, rows_after_filter long, truncated boolean"
    return local_frame(t.spark, [row], schema)


@query(
    "top_orders",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50",
)
def _(t):
    priced = t.orders.select("o_orderkey", "o_totalprice")
    return top_k(priced, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50)


@query(
    "top_orders_per_priority",
    """
    select o_orderpriority, o_orderkey, o_totalprice, cast(rank as int) as rank from (
      select o_orderpriority, o_orderkey, o_totalprice, row_number() over (
        partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rank
      from orders) where rank <= 3
    """,
)
def _(t):
    priced = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return top_k_per(priced, ["o_orderpriority"], order, 3)


@query(
    "distinct_rows",
    f"select l_linenumber, count(*) as rows from (select distinct * from {COPIES}) group by 1",
)
def _(t):
    kept = drop_duplicate_rows(t.copies())
    return kept.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("rows"))


@query("seeded_sample")
def _(t):
    return sample_rows(t.orders, 100)


@query(
    "quantiles_by_group",
    """
    select l_returnflag, 'l_extendedprice' as column, unnest([0.1, 0.25, 0.5, 0.9]::double[]) as prob,
      round(unnest(quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.9])), 4) as value
    from lineitem group by l_returnflag
    """,
)
def _(t):
    return rounded(
        quantile_table(t.lineitem, ["l_extendedprice"], [0.1, 0.25, 0.5, 0.9], ["l_returnflag"])
    )


@query(
    "quantiles_by_narrowing",
    """
    select l_linestatus, 'l_extendedprice' as column, unnest([0.05, 0.5, 0.95]::double[]) as prob,
      round(unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.95])), 4) as value
    from lineitem group by l_linestatus
    """,
)
def _(t):
    return rounded(
        quantile_table(
            t.lineitem, ["l_extendedprice"], [0.05, 0.5, 0.95], ["l_linestatus"]
        )
    )


@query(
    "filtered_rows",
    "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 450000 "
    "and o_orderpriority = '1-URGENT'",
)
def _(t):
    filters = [Filter("o_totalprice", ">", 450000), Filter("o_orderpriority", "=", "1-URGENT")]
    return apply_filters(t.orders, filters).select("o_orderkey", "o_custkey", "o_totalprice")
