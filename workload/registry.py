"""A query is a callable on the given tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The parquet tables of one scale factor, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def gaps(self) -> DataFrame:
        """lineitem with missing quantities and flags."""
        return self.lineitem.selectExpr(*GAP_COLUMNS)

    def copies(self) -> DataFrame:
        """lineitem with the first line of every order repeated."""
        return self.lineitem.union(self.lineitem.where("l_linenumber = 1"))

    def labelled(self) -> DataFrame:
        """documents with their labels, without the text."""
        kept = self.documents.select("doc_id", "lang", "source", "n_chars")
        return kept.join(self.labels, "doc_id")

    def spiked(self) -> DataFrame:
        """events with one day's values raised twentyfold."""
        day = F.to_date("ts") == F.lit("2024-01-17").cast("date")
        raised = F.when(day, F.col("value") * 20).otherwise(F.col("value"))
        return self.events.select("ts", "event_type", raised.alias("value"))

    def quiet_days(self) -> DataFrame:
        """All events, those of weekends moved to the Friday before but for rare, large ones: days with few or none."""
        after = F.dayofweek("ts") % 7  # 0 on Saturday, 1 on Sunday
        moved = (after < 2) & ~F.expr("event_type = 'error' and value > 200")
        at = F.when(moved, F.col("ts") - F.make_dt_interval(after + 1)).otherwise(F.col("ts"))
        return self.events.withColumn("ts", at)

    def measured_text(self) -> DataFrame:
        """part with prices, ratings and heights written as text."""
        return self.part.selectExpr(*TEXT_COLUMNS)


GAP_COLUMNS = (
    "l_orderkey", "l_linenumber",
    "case when l_linenumber % 5 = 0 then null else l_quantity end as quantity",
    "case when l_linenumber % 3 = 0 then null else l_returnflag end as flag",
    "l_linestatus as status", "l_extendedprice as price",
)
TEXT_COLUMNS = (
    "p_partkey",
    "concat('€', cast(cast(round(p_retailprice) as int) as string), 'K') as price",
    "concat(cast(p_size as string), '+2') as rating",
    "concat(cast(p_size % 8 as string), '''', cast(p_size % 12 as string)) as height",
    "p_name as name",
)
GAPS = f"(select {', '.join(GAP_COLUMNS)} from lineitem)"
COPIES = "(select * from lineitem union all select * from lineitem where l_linenumber = 1)"
LABELLED = (
    "(select doc_id, lang, source, n_chars, quality, toxic from documents join labels using (doc_id))"
)
SPIKED = (
    "(select ts, event_type, case when cast(ts as date) = date '2024-01-17' then value * 20 "
    "else value end as value from events)"
)
QUIET = """(select * replace (case when dayofweek(ts) in (0, 6) and not (event_type = 'error' and value > 200)
  then ts - to_days(case when dayofweek(ts) = 6 then 1 else 2 end) else ts end as ts) from events)"""
TEXTS = (
    "(select p_partkey, concat('€', cast(cast(round(p_retailprice) as int) as varchar), 'K') as price, "
    "concat(cast(p_size as varchar), '+2') as rating, "
    "concat(cast(p_size % 8 as varchar), '''', cast(p_size % 12 as varchar)) as height, "
    "p_name as name from part)"
)


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name, with its SQL where there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query '{name}' is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of a summation does not show; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + 0.0).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name)
            if isinstance(f.dataType, T.DateType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
