"""Profiling, gaps, duplicates, statistics, correlation, outliers and roles."""

from granary.functions.dates import as_datetime, date_orders, mask_counts
from granary.functions.kinds import column_kinds
from granary.operators import profiling
from granary.session import local_frame
from pyspark.sql import functions as F
from workload.registry import COPIES, GAPS, LABELLED, query, rounded


def _melt(table, columns, measures):
    """One select per column, unioned: the long form of a wide aggregation."""
    parts = [
        f"select '{c}' as \"column\", {measures.format(c=c)} from {table}" for c in columns
    ]
    return " union all ".join(parts)


EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
LINE_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)


@query(
    "column_kinds",
    """
    select * from (values (0, 'event_id', 'bigint', 'numeric'), (1, 'ts', 'timestamp_ntz', 'datetime'),
      (2, 'user_id', 'bigint', 'numeric'), (3, 'event_type', 'string', 'categorical'),
      (4, 'value', 'double', 'numeric'), (5, 'props', 'string', 'categorical'))
      v(position, "column", dtype, kind)
    """,
)
def _(t):
    return column_kinds(t.events)


@query(
    "column_profile",
    _melt(
        "events", EVENT_COLUMNS,
        "count(*) as rows, count_if({c} is null)::bigint as missing, count(distinct {c}) as distinct",
    ),
)
def _(t):
    found = profiling.analyze_dataset(t.events).columns
    return found.select("column", "rows", "missing", "distinct")


@query(
    "column_profile_with_gaps",
    _melt(
        GAPS, ("quantity", "flag", "status"),
        "count(*) as rows, count_if({c} is null)::bigint as missing, count(distinct {c}) as distinct",
    ),
)
def _(t):
    df = t.gaps().select("quantity", "flag", "status")
    return profiling.column_profile(df).select("column", "rows", "missing", "distinct")


@query(
    "dataset_summary",
    f"""
    select (select count(*) from {COPIES}) as rows, 11::bigint as columns,
      (select count(*) from {COPIES}) - (select count(*) from (select distinct * from {COPIES}))
        as duplicate_rows
    """,
)
def _(t):
    found = profiling.analyze_dataset(t.copies()).summary
    return found.select("rows", "columns", "duplicate_rows")


@query(
    "duplicate_rows",
    "select (sum(n) - count(*))::bigint as duplicate_rows from (select flag, quantity, status, "
    f"count(*) as n from {GAPS} group by all)",
)
def _(t):
    return profiling.duplicate_rows(t.gaps().select("flag", "quantity", "status"))


@query(
    "missing_by_column",
    f"""
    select 'flag' as "column", count_if(flag is null)::bigint as missing,
      round(100.0 * count_if(flag is null) / count(*), 2) as pct, 'mode' as imputation from {GAPS}
    union all
    select 'quantity', count_if(quantity is null)::bigint,
      round(100.0 * count_if(quantity is null) / count(*), 2), 'median' from {GAPS}
    """,
)
def _(t):
    return profiling.detect_missing_values(t.gaps()).columns


@query(
    "missing_totals",
    f"""
    select (count_if(flag is null) + count_if(quantity is null))::bigint as total_missing,
      round(100.0 * (count_if(flag is null) + count_if(quantity is null)) / (count(*) * 6), 2)
        as pct_missing,
      2::bigint as columns_affected, 0::bigint as empty_columns
    from {GAPS}
    """,
)
def _(t):
    return profiling.detect_missing_values(t.gaps()).totals


@query(
    "numeric_statistics",
    _melt(
        "lineitem", LINE_NUMBERS,
        "count({c}) as count, round(avg({c}), 4) as mean, "
        "round(quantile_cont({c}::double, 0.5), 4) as median, round(stddev_samp({c}), 4) as std, "
        "min({c})::double as min, round(quantile_cont({c}::double, 0.25), 4) as q1, "
        "round(quantile_cont({c}::double, 0.75), 4) as q3, max({c})::double as max",
    ),
)
def _(t):
    return rounded(profiling.generate_statistics(t.lineitem).numeric)


@query(
    "categorical_statistics",
    """
    with m as (
      select 'o_orderstatus' as "column", o_orderstatus as value from orders
      union all select 'o_orderpriority', o_orderpriority from orders),
    c as (select "column", value, count(*) as count from m group by 1, 2),
    r as (select *, row_number() over (partition by "column" order by count desc, value) as rank,
      count(*) over (partition by "column") as "distinct" from c)
    select "column", "distinct", cast(rank as int) as rank, value, count from r where rank <= 5
    """,
)
def _(t):
    df = t.orders.select("o_orderstatus", "o_orderpriority", "o_totalprice")
    return profiling.generate_statistics(df).categorical


@query(
    "correlation_top_pairs",
    "select * from ("
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from lineitem"
        for i, a in enumerate(LINE_NUMBERS)
        for b in LINE_NUMBERS[i + 1 :]
    )
    + ") order by abs(corr) desc, a, b limit 10",
)
def _(t):
    return rounded(profiling.generate_correlation_matrix(t.lineitem).top_pairs, 6)


@query(
    "correlation_matrix",
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 3) as corr from part"
        for a in ("p_partkey", "p_size", "p_retailprice")
        for b in ("p_partkey", "p_size", "p_retailprice")
    ),
)
def _(t):
    return rounded(profiling.generate_correlation_matrix(t.part).matrix, 3)


@query(
    "correlation_skips_gaps",
    f"select 'quantity' as a, 'price' as b, round(corr(quantity, price), 6) as corr from {GAPS}",
)
def _(t):
    return rounded(profiling.correlation_pairs(t.gaps(), ["quantity", "price"]), 6)


@query(
    "outlier_counts",
    """
    with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events),
    b as (select q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from q)
    select 'value' as "column", count_if(value < low or value > high)::bigint as outliers,
      round(100.0 * count_if(value < low or value > high) / count(value), 2) as pct,
      round(any_value(low), 4) as low, round(any_value(high), 4) as high
    from events, b
    """,
)
def _(t):
    return rounded(profiling.detect_outliers(t.events))


@query(
    "schema_catalogue",
    """
    with m as (select 'o_orderstatus' as "column", o_orderstatus as value from orders
      union all select 'o_orderpriority', o_orderpriority from orders),
    e as (select "column", string_agg(value, '|' order by n desc, value) as examples from (
      select "column", value, count(*) as n from m group by 1, 2) group by 1),
    s as (
      select 'o_orderkey' as "column", 'numeric' as kind, count(distinct o_orderkey) as "distinct",
        min(o_orderkey)::double as min, max(o_orderkey)::double as max from orders
      union all select 'o_custkey', 'numeric', count(distinct o_custkey), min(o_custkey)::double,
        max(o_custkey)::double from orders
      union all select 'o_orderstatus', 'categorical', count(distinct o_orderstatus), null, null from orders
      union all select 'o_totalprice', 'numeric', count(distinct o_totalprice), min(o_totalprice),
        max(o_totalprice) from orders
      union all select 'o_orderdate', 'datetime', count(distinct o_orderdate), null, null from orders
      union all select 'o_orderpriority', 'categorical', count(distinct o_orderpriority), null, null
        from orders)
    select s."column", kind, 0::bigint as missing, "distinct", min, max, examples
    from s left join e using ("column")
    """,
)
def _(t):
    found = profiling.describe_schema(t.orders)
    shown = F.array_join("examples", "|").alias("examples")
    return found.select("column", "kind", "missing", "distinct", "min", "max", shown)


@query(
    "role_suggestions",
    """
    select * from (values ('l_orderkey', 'measure'), ('l_partkey', 'measure'),
      ('l_suppkey', 'measure'), ('l_linenumber', 'dimension'), ('l_linenumber', 'measure'),
      ('l_quantity', 'measure'), ('l_extendedprice', 'measure'), ('l_discount', 'dimension'),
      ('l_discount', 'measure'), ('l_tax', 'dimension'), ('l_tax', 'measure'),
      ('l_returnflag', 'dimension'), ('l_linestatus', 'dimension'), ('l_shipdate', 'date'))
      v("column", role)
    """,
)
def _(t):
    return profiling.suggest_roles(t.lineitem).select("column", "role")


@query(
    "class_balance",
    """
    select count(*) as classes, round(max(n) / sum(n), 4) as largest_share,
      max(n) / sum(n) >= 0.65 and count(*) >= 2 as imbalanced
    from (select toxic, count(*)::double as n from labels where toxic is not null group by 1)
    """,
)
def _(t):
    return profiling.class_balance(t.labels, "toxic").summary


@query(
    "class_counts",
    "select o_orderpriority as value, count(*) as count from orders group by 1",
)
def _(t):
    return profiling.class_balance(t.orders, "o_orderpriority").counts


@query(
    "target_scores",
    f"""
    with s as (
      select 'lang' as "column", 'categorical' as kind, count(distinct lang) as distinct, 10 as score,
        'classification' as suggested_task from {LABELLED}
      union all select 'n_chars', 'numeric', count(distinct n_chars), 10, 'regression' from {LABELLED}
      union all select 'quality', 'numeric', count(distinct quality), 5, 'classification' from {LABELLED}
      union all select 'toxic', 'numeric', count(distinct toxic), 5, 'classification' from {LABELLED})
    select * from s
    """,
)
def _(t):
    df = t.labelled().select("lang", "n_chars", "quality", "toxic")
    found = profiling.detect_problem_type(df, exact=True).candidates
    return found.select("column", "kind", "distinct", "score", "suggested_task")


@query(
    "target_by_name_hint",
    "select 'regression' as task, 'o_totalprice' as target, 'high' as confidence, true as auto",
)
def _(t):
    d = profiling.detect_problem_type(t.orders, exact=True)
    row = (d.problem_type, d.target, d.confidence, d.auto_detected)
    return local_frame(t.spark, [row], "task string, target string, confidence string, auto boolean")


DATES_AS_TEXT = (
    "date_format(o_orderdate, 'yyyy-MM-dd') as order_date",
    "date_format(o_orderdate, 'MM/dd/yyyy') as us_day", "o_orderpriority as note",
)


@query(
    "datetime_columns",
    """
    select 'order_date' as "column", count(*) as values,
      count(try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')) as dates from orders
    union all select 'us_day', count(*),
      count(try_strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y')) from orders
    union all select 'note', count(*), 0 from orders
    """,
)
def _(t):
    df = t.orders.selectExpr(*DATES_AS_TEXT)
    rates = profiling.date_parse_rates(df)
    found = profiling.detect_datetime_columns(df)
    assert found == ["order_date", "us_day"], found
    rows = [(c, n, round(n * rate)) for c, (n, rate) in rates.items()]
    return local_frame(t.spark, rows, "column string, values long, dates long")


@query(
    "text_as_datetime",
    "select count(*) as dated, min(o_orderdate) as first, max(o_orderdate) as last from orders",
)
def _(t):
    df = t.orders.selectExpr(*DATES_AS_TEXT)
    when = as_datetime(df, "us_day", 4)
    return df.agg(
        F.count(when).alias("dated"), F.min(when).alias("first"), F.max(when).alias("last")
    )


MANY_LAYOUTS = [
    "o_orderkey", "date_format(o_orderdate, 'dd/MM/yyyy') as day_first",
    "date_format(o_orderdate, 'M-d-yyyy HH:mm') as month_first",
    "if(day(o_orderdate) <= 12, date_format(o_orderdate, 'MM/dd/yyyy'), null) as unsettled",
    "if(o_orderkey % 2 = 0, date_format(o_orderdate, 'dd.MM.yyyy'), date_format(o_orderdate, 'yyyy-MM-dd')) as dotted",
    "date_format(o_orderdate, if(o_orderkey % 3 = 0, 'd MMMM yyyy', 'MMM d, yyyy')) as named",
]


@query(
    "dates_in_many_layouts",
    """
    select o_orderkey, o_orderdate::date as day_first, o_orderdate::date as month_first,
      case when day(o_orderdate) <= 12 then o_orderdate::date end as unsettled,
      o_orderdate::date as dotted, o_orderdate::date as named from orders
    """,
)
def _(t):
    df = t.orders.selectExpr(*MANY_LAYOUTS)
    columns = df.columns[1:]
    orders = date_orders(df, columns)
    return df.select("o_orderkey", *[as_datetime(df, c, order=orders[c]).cast("date").alias(c) for c in columns])


@query(
    "date_masks_counted",
    """
    with x as (
      select 'day_first' as "column", strftime(o_orderdate, '%d/%m/%Y') as text from orders
      union all select 'dotted', case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%d.%m.%Y')
        else strftime(o_orderdate, '%Y-%m-%d') end from orders
      union all select 'unsettled', case when day(o_orderdate) <= 12 then strftime(o_orderdate, '%m/%d/%Y') end from orders
    )
    select "column", regexp_replace(text, '[0-9]', '0', 'g') as mask, count(*) as rows,
      count(*) filter (text not like '%-%' and try_cast(text[1:2] as int) > 12) as first_over_12,
      count(*) filter (text not like '%-%' and try_cast(text[4:5] as int) > 12) as second_over_12
    from x where text is not null group by all
    """,
)
def _(t):
    return mask_counts(t.orders.selectExpr(*MANY_LAYOUTS), ["day_first", "dotted", "unsettled"])


@query(
    "identifier_columns",
    """
    select "column" from (
      select 'event_id' as "column", count(distinct event_id) as n, max(event_id) - min(event_id) + 1
        as span, count(*) as rows from events
      union all select 'user_id', count(distinct user_id), max(user_id) - min(user_id) + 1, count(*)
        from events
      union all select 'ts', count(distinct ts), 0, count(*) from events)
    where n >= 0.95 * rows and n >= 20 and span <= 1.5 * n
    """,
)
def _(t):
    found = profiling.identifier_columns(t.events)
    return local_frame(t.spark, [(c,) for c in found], "column string")


@query(
    "dashboard_layout",
    """
    select * from (values ('l_orderkey', 'measure'), ('l_partkey', 'measure'), ('l_suppkey', 'measure'),
      ('l_linenumber', 'dimension'), ('l_quantity', 'measure'), ('l_discount', 'dimension'),
      ('l_tax', 'dimension'), ('l_returnflag', 'dimension'), ('l_linestatus', 'dimension'),
      ('l_shipdate', 'date')) v("column", role)
    """,
)
def _(t):
    df = t.lineitem.drop("l_extendedprice")
    return profiling.dashboard_layout(df).select("column", "role")


@query(
    "filter_options",
    """
    with m as (select 'p_name' as "column", p_name as value from part
      union all select 'p_type', p_type from part),
    c as (select "column", value, count(*) as count from m group by 1, 2),
    r as (select *, row_number() over (partition by "column" order by count desc, value) as rank,
      count(*) over (partition by "column") > 25 as truncated from c)
    select "column", cast(rank as int) as rank, value, count, truncated from r where rank <= 25
    """,
)
def _(t):
    return profiling.filter_options(t.part, ["p_name", "p_type"])
