"""Scalar expressions: numbers in text, periods, derived columns, scaling, null rules."""

from granary.functions.arithmetic import derive, round_half_up, standardise
from granary.functions.dates import month, period_end, weekday
from granary.functions.kinds import col, normalise_nulls
from granary.functions.text_numbers import additive, feet_inches, numeric_text, to_number
from granary.operators.features import Derived, build_features
from pyspark.sql import functions as F
from workload.registry import TEXTS, dates_as_text, query, rounded


@query(
    "numbers_in_text",
    f"""
    select p_partkey, cast(regexp_extract(price, '(\\d+)', 1) as double) * 1000 as price,
      cast(split_part(rating, '+', 1) as double) + 2 as rating,
      cast(split_part(height, '''', 1) as double) * 12 + cast(split_part(height, '''', 2) as double)
        as height,
      cast(null as double) as name
    from {TEXTS}
    """,
)
def _(t):
    df = t.measured_text()
    names = ("price", "rating", "height", "name")
    return df.select("p_partkey", *[numeric_text(col(c)).alias(c) for c in names])


@query(
    "feet_and_inches",
    f"""
    select p_partkey, cast(split_part(height, '''', 1) as double) * 12
      + cast(split_part(height, '''', 2) as double) as inches, cast(null as double) as other
    from {TEXTS}
    """,
)
def _(t):
    df = t.measured_text()
    return df.select(
        "p_partkey", feet_inches(col("height")).alias("inches"), feet_inches(col("price")).alias("other")
    )


@query(
    "sums_in_text",
    f"select p_partkey, cast(split_part(rating, '+', 1) as double) + 2 as rating from {TEXTS}",
)
def _(t):
    return t.measured_text().select("p_partkey", additive(col("rating")).alias("rating"))


@query(
    "text_to_number_or_null",
    "select p_partkey, try_cast(p_name as double) as name, "
    "try_cast(cast(p_retailprice as varchar) as double) as price from part",
)
def _(t):
    return t.part.select(
        "p_partkey", to_number(col("p_name")).alias("name"),
        to_number(F.col("p_retailprice").cast("string")).alias("price"),
    )


@query(
    "period_ends",
    """
    select o_orderkey, strftime(d, '%Y-%m-%d') as day,
      strftime(d + ((7 - isodow(d)) % 7)::int, '%Y-%m-%d') as week,
      strftime(last_day(d), '%Y-%m-%d') as month,
      strftime(last_day((date_trunc('quarter', d) + interval 2 month)::date), '%Y-%m-%d') as quarter,
      strftime(last_day((date_trunc('year', d) + interval 11 month)::date), '%Y-%m-%d') as year
    from (select o_orderkey, o_orderdate::date as d from orders)
    """,
)
def _(t):
    named = {"day": "D", "week": "W", "month": "ME", "quarter": "QE", "year": "YE"}
    ends = [period_end(F.col("o_orderdate"), f).alias(n) for n, f in named.items()]
    return dates_as_text(t.orders.select("o_orderkey", *ends))


@query(
    "month_and_weekday",
    "select extract(month from ts)::int as month, (isodow(ts) - 1)::int as weekday, "
    "count(*) as rows from events group by 1, 2",
)
def _(t):
    df = t.events.select(month(F.col("ts")).alias("month"), weekday(F.col("ts")).alias("weekday"))
    return df.groupBy("month", "weekday").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "derived_values",
    """
    select l_orderkey, l_partkey, l_linenumber,
      round(l_quantity * l_discount, 6) as product, round(l_quantity - l_tax, 6) as difference,
      case when abs(l_discount) > 1e-9 then round(l_extendedprice / l_discount, 4) end as ratio
    from lineitem
    """,
)
def _(t):
    df = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.round(derive("product", F.col("l_quantity"), F.col("l_discount")), 6).alias("product"),
        F.round(derive("difference", F.col("l_quantity"), F.col("l_tax")), 6).alias("difference"),
        F.round(derive("ratio", F.col("l_extendedprice"), F.col("l_discount")), 4).alias("ratio"),
    )
    return df


@query(
    "derived_columns_feed_each_other",
    """
    select p_partkey, round(p_retailprice * p_size, 4) as p_retailprice_x_p_size,
      round(p_retailprice * p_size - p_size, 4) as net
    from part
    """,
)
def _(t):
    specs = [
        Derived("product", "p_retailprice", "p_size"),
        Derived("difference", "p_retailprice_x_p_size", "p_size", "net"),
        Derived("ratio", "p_size", "p_size", "always_one"),
        Derived("product", "always_one", "p_size", "needs_a_rejected_one"),
    ]
    built, added = build_features(t.part, specs)
    return rounded(built.select("p_partkey", *added))


@query(
    "standardised_column",
    """
    select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over (), 4)
      as z from customer
    """,
)
def _(t):
    mean, scale = t.customer.agg(F.avg("c_acctbal"), F.stddev_pop("c_acctbal")).first()
    z = standardise(F.col("c_acctbal"), mean, scale)
    return rounded(t.customer.select("c_custkey", z.alias("z")))


@query(
    "not_a_number_becomes_null",
    """
    select p_type, count(case when p_size > 10 then p_retailprice end) as known,
      round(avg(case when p_size > 10 then p_retailprice end), 4) as mean,
      max(case when p_size > 10 then p_retailprice end) as largest
    from part group by 1
    """,
)
def _(t):
    broken = F.expr(
        "case when p_size <= 5 then double('NaN') when p_size <= 10 then double('Infinity') "
        "else p_retailprice end"
    )
    df = normalise_nulls(t.part.select("p_type", broken.alias("price")))
    return df.groupBy("p_type").agg(
        F.count("price").alias("known"), F.round(F.avg("price"), 4).alias("mean"),
        F.max("price").alias("largest"),
    )


@query(
    "rounded_lowercase_nulls",
    "select p_partkey, round(p_retailprice, 1) as price, lower(p_type) as type, "
    "p_name is null as unnamed from part",
)
def _(t):
    return t.part.select(
        "p_partkey", round_half_up(F.col("p_retailprice"), 1).alias("price"),
        F.lower("p_type").alias("type"), F.col("p_name").isNull().alias("unnamed"),
    )
