"""Session helpers shared by the operators."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from granary.errors import ProcessingError, ValidationError

#: Rows below which a table takes no further partition, and rows that a partition holds at most.
FEW_ROWS, MANY_ROWS = 10_000, 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ProcessingError("Set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    return folder


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame across the passes of one operator. Spills to disk, rebuilt if lost."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def spread(df: DataFrame, rows: int) -> DataFrame:
    """A frame of ``rows`` rows dealt evenly over partitions, for many passes over it.

    Three tasks a core at most, fewer for a small table, more for one too large for that: a file of one
    row group doesn't stay in one task, nor do a few rows make a task of each shuffle partition.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(min(math.ceil(rows / FEW_ROWS), 3 * cores), math.ceil(rows / MANY_ROWS), 1)
    return df.repartition(wanted)


#: Whether Spark deletes a query's shuffle files when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What queries in the block shuffled is deleted as soon as each of them ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame with a reliable checkpoint.

    Spark computes a frame once to run it and again to write it, so it is kept meanwhile.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with reused(df) as kept:
        return kept.checkpoint()


def take_bounded(df: DataFrame, limit: int, message: str) -> list[Row]:
    """Rows of a result that must be small: never fetches more than ``limit + 1``."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValidationError(message)
    return rows


def local_frame(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    """A small result as a local relation: handed over as Arrow, so no Python worker starts."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [()] * len(schema.fields)
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(list(v), type=f.type) for v, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema)


def chunks(items: Sequence, size: int) -> list[list]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def numbered_copies(df: DataFrame, name: str) -> DataFrame:
    """The rows with a column that numbers equal rows 1, 2, ...; without gathering equal rows.

    Equal rows are counted in each task before they are shuffled and dealt out again from their
    count, so the numbers depend on the content only, never on the partitioning.
    """
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
    times = f"{name}_times"
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(times))
    return counted.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(name))


def looked_up(rows: DataFrame, table: DataFrame, on: Sequence[str], spread: str, limit: int) -> DataFrame:
    """``rows`` left-joined with the one row that ``table`` has for each key of the columns ``on``.

    Column ``n`` of ``table`` says how many of ``rows`` hold the key. Keys of more than ``limit``
    rows are dealt out over several parts by the column ``spread``, and their row of the table is
    repeated for each part, so no task gets all rows of a hot key. Only a hash of such keys, at
    most count / limit of them, is broadcast; the join itself compares the keys.
    """
    place, parts = F.xxhash64(*on), F.ceil(F.col("n") / limit)
    hot = F.broadcast(
        table.where(F.col("n") > limit).groupBy(place.alias("place")).agg(F.max(parts).alias("parts"))
    )
    part = F.pmod(F.xxhash64(spread), F.coalesce("parts", F.lit(1)))
    left = rows.withColumn("place", place).join(hot, "place", "left").withColumn("part", part)
    last = F.coalesce("parts", F.lit(1)) - 1
    right = table.withColumn("place", place).join(hot, "place", "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return left.drop("place", "parts").join(right.drop("place", "parts"), [*on, "part"], "left").drop("part")
