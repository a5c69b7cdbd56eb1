"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for the linked nodes: ``root`` is the smallest node that links reach.

    ``links`` has columns ``a`` and ``b`` of one orderable type; loops, repeats and nulls in them
    are ignored, an empty table gives an empty table. Each round moves every node's larger
    neighbours to its smallest one, then the smaller ones likewise, so even a long chain settles
    in about log(n) rounds. Rounds are tables in the shared folder. The least neighbours are a
    table as well: both sides of their join are then shuffled for it, and Spark can split a hub.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(ends.distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        # edges hold the larger end first; a node's least neighbour, itself included
        both = edges.union(edges.select("b", "a"))
        least = stored(
            both.groupBy("a").agg(F.min("b").alias("low")).where("low < a"), "least"
        ).withColumnRenamed("a", "node")
        up = edges.join(least, F.col("b") == F.col("node"), "left").select(
            "a", F.coalesce("low", "b").alias("b")
        )
        up = stored(up.distinct(), "large")
        down = stored(up.groupBy("a").agg(F.min("b").alias("low")), "small").withColumnRenamed("a", "node")
        moved = up.join(down, F.col("a") == F.col("node")).where("b <> low")
        edges = stored(
            moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(down.select("node", "low"))
            .distinct(),
            "edges",
        )
