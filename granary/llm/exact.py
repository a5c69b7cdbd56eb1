"""Exact duplicates by distributed radix partitioning, most significant bytes first.

Documents start in one group. Each round splits every open group by the next bytes of its texts
(a digit of 4096 bytes first, each later one 64 times as wide): rows are counted per group and
digit, and a row goes on with the rest of its text in the group of its digit. A group is finished
when it holds a single document, or when its texts have ended; texts that were never told apart
and ended together are equal. Bytes are compared as bytes, so equality rests on no digest.

Most documents differ from all others in their first digit. Their group is told single by a table
of bits over hashed first digits, of bounded size, so their texts are never shuffled; a hash that
two digits share only leaves a document open for the first round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import looked_up, stored

#: Bytes of the first digit, and how much wider each next one is, up to WIDEST.
FIRST, WIDER, WIDEST = 4096, 64, 1 << 24
#: Bits of the table that tells single documents: 2**20 words of 64 bits are the most it sends.
BITS = 1 << 26
#: Rows of a group that travel to one task; larger groups are dealt out.
GROUP_ROWS = 10_000


def spaced(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _crowded(rows: DataFrame) -> DataFrame:
    """``(word, bits)``: the buckets of first digits that more than one row has, 64 to a word."""
    counted = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return counted.groupBy(F.shiftright("bucket", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bucket & 63 as int)))").alias("bits")
    )


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", same: Callable[[Column], Column] = spaced,
    first: int = FIRST, bits: int = BITS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal when they are after ``same``. Of equal texts the row with the smallest key
    stays: ``kept`` is true for exactly one row of each group, and ``keep_id`` is its key. Null
    texts are empty texts. Null keys are larger than any other; of several rows with the smallest
    key, or with null keys only, one stays. An empty table gives an empty table. Other columns
    are not read. ``text_sha256`` is for the reader and takes no part in the comparison.
    """
    body = same(F.col(text)).cast("binary")
    rows = docs.select(F.col(key).alias("id"), body.alias("rest"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.substring("rest", 1, first)), F.lit(bits)))
    words = F.broadcast(stored(_crowded(rows), "crowded"))
    met = rows.withColumn("word", F.shiftright("bucket", 6)).join(words, "word", "left")
    shared = F.expr("coalesce(bits & shiftleft(1L, cast(bucket & 63 as int)), 0L) <> 0")
    state = stored(
        met.select(
            F.monotonically_increasing_id().alias("row"), "id", F.lit(0).cast("long").alias("g"),
            F.unhex(F.sha2("rest", 256)).alias("sha"), F.when(shared, F.col("rest")).alias("rest"),
            F.lit(None).cast("long").alias("n"), F.lit(None).cast(docs.schema[key].dataType).alias("keep"),
        ),
        "open",
    )
    finished, width = None, first
    while True:
        done = state.where("rest is null").drop("rest")
        finished = done if finished is None else finished.union(done)
        going = state.where("rest is not null").drop("n", "keep")
        open_rows = going.count()
        if not open_rows:
            return _named(finished, key)
        # digit and tail, so that each byte travels once
        going = going.select(
            "row", "id", "g", "sha", F.substring("rest", 1, width).alias("digit"),
            F.expr(f"substring(rest, {width + 1})").alias("tail"),
        )
        groups = going.groupBy("g", "digit").agg(
            F.count("*").alias("n"), F.min("row").alias("low"), F.min("id").alias("keep")
        )
        groups = stored(groups.where("n > 1"), "groups")
        limit = max(group_rows, open_rows // 4096)
        split = looked_up(going, groups, ["g", "digit"], "row", limit)
        goes_on = F.when((F.col("n") > 1) & (F.length("digit") == width), F.col("tail"))
        state = stored(split.select("row", "id", F.col("low").alias("g"), "sha", goes_on.alias("rest"), "n", "keep"), "open")
        width = min(width * WIDER, WIDEST)


def _named(finished: DataFrame, key: str) -> DataFrame:
    """Rows with their groups: one of the rows that have the group's smallest key stays."""
    staying = finished.where("n > 1 and id <=> keep").groupBy("g").agg(F.min("row").alias("row"))
    staying = staying.select("row", F.lit(True).alias("stays"))
    alone = F.col("n").isNull()
    return finished.join(staying, "row", "left").select(
        F.col("id").alias(key), F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.coalesce("stays", F.lit(False))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
