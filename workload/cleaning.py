"""Coercion, imputation, the full clean, outlier rows, feature preparation, splits and weights."""

import uuid

from granary.errors import ValidationError
from granary.operators import clean, features
from granary.session import local_frame, shared_folder
from granary.sources.tables import preview, read_csv, validate_table
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from workload.registry import COPIES, GAPS, TEXTS, query


@query(
    "text_columns_become_numbers",
    f"""
    select round(sum(cast(regexp_extract(price, '(\\d+)', 1) as double) * 1000), 2) as price,
      sum(cast(split_part(rating, '+', 1) as double) + 2) as rating,
      sum(cast(split_part(height, '''', 1) as double) * 12
        + cast(split_part(height, '''', 2) as double)) as height,
      max(name) as name, 'height,price,rating' as converted
    from {TEXTS}
    """,
)
def _(t):
    df, converted = clean.coerce_numeric_columns(t.measured_text())
    return df.agg(
        F.round(F.sum("price"), 2).alias("price"), F.sum("rating").alias("rating"),
        F.sum("height").alias("height"), F.max("name").alias("name"),
        F.lit(",".join(sorted(converted))).alias("converted"),
    )


def _filled_sql(number, text="flag"):
    return f"""
    select status, {text} as flag, count(*) as rows, round(sum({number}), 2) as total
    from {GAPS} group by 1, 2
    """


def _filled(t, **strategies):
    df, _ = clean.impute(t.gaps(), **strategies)
    grouped = df.groupBy("status", "flag")
    return grouped.agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("quantity"), 2).alias("total")
    )


MEDIAN = f"coalesce(quantity, (select quantile_cont(quantity, 0.5) from {GAPS}))"
MEAN = f"coalesce(quantity, (select avg(quantity) from {GAPS}))"
MODE = (
    f"coalesce(flag, (select flag from {GAPS} where flag is not null group by flag "
    "order by count(*) desc, flag limit 1))"
)


@query("impute_median_and_mode", _filled_sql(MEDIAN, MODE))
def _(t):
    return _filled(t)


@query("impute_mean_and_constant", _filled_sql(MEAN, "coalesce(flag, 'missing')"))
def _(t):
    return _filled(t, numeric="mean", categorical="constant")


@query("impute_zero", _filled_sql("coalesce(quantity, 0)", MODE))
def _(t):
    return _filled(t, numeric="zero")


@query(
    "imputation_table",
    f"""
    select 'quantity' as "column", 'mean' as strategy, count(*) as count from {GAPS} where quantity is null
    union all select 'flag', 'mode', count(*) from {GAPS} where flag is null
    """,
)
def _(t):
    return clean.impute(t.gaps(), numeric="mean")[1].select("column", "strategy", "count")


CLEAN_INPUT = f"(select flag, status, quantity from {GAPS})"


@query(
    "clean_report",
    f"""
    select 'rows_before' as step, null as "column", count(*) as count from {CLEAN_INPUT}
    union all select 'rows_after', null, count(*) from (select distinct * from {CLEAN_INPUT})
    union all select 'drop_duplicates', null,
      (select count(*) from {CLEAN_INPUT}) - (select count(*) from (select distinct * from {CLEAN_INPUT}))
    union all select 'drop_empty_column', 'nothing', count(*) from {CLEAN_INPUT}
    union all select 'impute_mode', 'flag', count(*) from (select distinct * from {CLEAN_INPUT})
      where flag is null
    union all select 'impute_median', 'quantity', count(*) from (select distinct * from {CLEAN_INPUT})
      where quantity is null
    """,
)
def _(t):
    df = t.gaps().select("flag", "status", "quantity", F.lit(None).cast("double").alias("nothing"))
    return clean.clean_dataset(df).report.select("step", "column", "count")


@query(
    "cleaned_rows",
    f"""
    with u as (select distinct * from {CLEAN_INPUT}),
    m as (select quantile_cont(quantity, 0.5) as q from u),
    f as (select flag as f from u where flag is not null group by 1 order by count(*) desc, 1 limit 1)
    select coalesce(flag, f) as flag, status, coalesce(quantity, q) as quantity from u, m, f
    """,
)
def _(t):
    return clean.clean_dataset(t.gaps().select("flag", "status", "quantity")).frame


@query(
    "cleaned_without_duplicates",
    f"select count(*) as rows, round(sum(l_extendedprice), 2) as total "
    f"from (select distinct * from {COPIES})",
)
def _(t):
    cleaned = clean.clean_dataset(t.copies())
    total = F.round(F.sum("l_extendedprice"), 2).alias("total")
    return cleaned.frame.agg(F.count(F.lit(1)).alias("rows"), total)


@query(
    "empty_columns_dropped",
    "select p_partkey, p_size from part",
)
def _(t):
    df = t.part.select("p_partkey", "p_size", F.lit(None).cast("string").alias("nothing"))
    return clean.drop_empty_columns(df)[0]


BOUNDS = """
    with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events),
    b as (select q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from q)
"""


@query(
    "outlier_rows",
    BOUNDS + "select event_type, value < low or value > high as is_outlier, count(*) as rows "
    "from events, b group by 1, 2",
)
def _(t):
    flagged = clean.outlier_rows(t.events, ["value", "user_id", "event_type"])
    return flagged.groupBy("event_type", "is_outlier").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "outlier_rows_dropped",
    BOUNDS + "select event_id, value from events, b where not (value < low or value > high)",
)
def _(t):
    return clean.drop_outliers(t.events, ["value"]).frame.select("event_id", "value")


@query("outlier_rows_kept_when_too_many", "select event_id, value from events")
def _(t):
    return clean.drop_outliers(t.events, ["value"], max_loss=0.001).frame.select("event_id", "value")


@query(
    "prepared_matrix",
    """
    select 'p_size' as feature, round(sum(z * z), 3) as squares, count_if(z <> 0)::bigint as filled
    from (select (p_size - avg(p_size) over ()) / stddev_pop(p_size) over () as z from part)
    union all select 'p_retailprice', round(sum(z * z), 3), count_if(z <> 0)::bigint from (
      select (p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over () as z
      from part)
    union all select concat('p_type_', p_type), count(*)::double, count(*) from part group by 1
    """,
)
def _(t):
    ready, prep = features.prepare_features(
        t.part, None, "clustering", ["p_size", "p_retailprice", "p_type", "p_name"]
    )
    cells = ready.select(F.posexplode(vector_to_array("features")).alias("place", "x"))
    names = F.array(*[F.lit(n) for n in prep.feature_names])
    sums = cells.groupBy("place").agg(
        F.round(F.sum(F.col("x") * F.col("x")), 3).alias("squares"),
        F.count_if(F.col("x") != 0).alias("filled"),
    )
    return sums.select(F.element_at(names, F.col("place") + 1).alias("feature"), "squares", "filled")


@query(
    "labels_in_text_order",
    """
    with c as (select o_orderpriority as p, count(*) as rows from orders group by 1)
    select (row_number() over (order by p) - 1)::double as label, p as predicted, rows from c
    """,
)
def _(t):
    prep = features.fit_preparation(
        t.orders, "o_orderpriority", "classification", ["o_totalprice"]
    )
    labelled = prep.labelled(t.orders).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    return prep.decode(labelled, "label")


@query(
    "unseen_category_encodes_to_zeros",
    """
    select p_type, count(*) as rows, case when p_type = 'PROMO' then 0 else count(*) end::bigint
      as encoded
    from part group by 1
    """,
)
def _(t):
    prep = features.fit_preparation(
        t.part.where("p_type <> 'PROMO'"), None, "clustering", ["p_size", "p_type"]
    )
    ready = prep.transform(t.part, ["p_type"])
    hot = F.aggregate(
        F.slice(vector_to_array("features"), 2, 50), F.lit(0.0), lambda a, x: a + x
    )
    return ready.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(hot).cast("bigint").alias("encoded")
    )


@query("split_keeps_every_row_once", "select count(*) as rows, 0::bigint as shared from orders")
def _(t):
    train, test = features.split_data(t.orders, "o_orderstatus", "classification")
    sides = train.select("o_orderkey", F.lit(0).alias("side")).union(
        test.select("o_orderkey", F.lit(1).alias("side"))
    )
    per_row = sides.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per_row.agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("shared")
    )


@query("split_sides")
def _(t):
    train, test = features.split_data(t.orders, "o_orderstatus", "classification")
    sides = train.withColumn("side", F.lit("train")).union(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side", "o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "class_weights",
    """
    select toxic, round(sum(w), 4) as weight from (
      select toxic, (count(*) over ())::double
        / ((select count(distinct toxic) from labels) * count(*) over (partition by toxic)) as w
      from labels) group by 1
    """,
)
def _(t):
    weighted = features.balance_weights(t.labels, "toxic")
    return weighted.groupBy("toxic").agg(F.round(F.sum("weight"), 4).alias("weight"))


@query("proposed_features")
def _(t):
    df = t.part.withColumn("amount", F.col("p_size") * F.col("p_retailprice"))
    specs = features.propose_features(df, "amount", "regression", ["p_size", "p_retailprice"])
    rows = [(s.column, s.relevance, s.parent_relevance) for s in specs]
    return local_frame(t.spark, rows, "column string, relevance double, parent_relevance double")


@query(
    "csv_with_detected_separator",
    "select o_orderstatus, count(*) as rows, round(sum(o_totalprice), 2) as total, "
    "sum(o_custkey)::bigint as keys, count(o_orderpriority) as priorities from orders group by 1",
)
def _(t):
    path = f"{shared_folder(t.spark)}/orders-{uuid.uuid4().hex}"
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    t.orders.select(*columns).write.option("header", True).option("sep", ";").csv(path)
    df = read_csv(t.spark, path)
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.sum("o_custkey").alias("keys"), F.count("o_orderpriority").alias("priorities"),
    )


@query("preview_rows")
def _(t):
    return preview(t.lineitem)


@query("table_accepted", "select count(*) as rows, false as empty_accepted from lineitem")
def _(t):
    kept = validate_table(t.lineitem, max_columns=150)
    try:
        validate_table(t.lineitem.where("l_quantity < 0"))
        empty_accepted = True
    except ValidationError:
        empty_accepted = False
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.lit(empty_accepted).alias("empty_accepted"))
