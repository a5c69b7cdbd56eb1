"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import settled

# The kernel travels to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Links that one task contracts by itself; more are contracted in rounds, with the same result.
SMALL = 100_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        # a root takes the smallest root that one of its links leads to; then paths are halved
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _contracted(links: pd.DataFrame) -> pd.DataFrame:
    nodes, roots = smallest_reached(links["a"].to_numpy(), links["b"].to_numpy())
    moved = nodes != roots
    return pd.DataFrame({"node": nodes[moved], "root": roots[moved]})


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """``(node, root)`` for the linked nodes: ``root`` is the smallest node that links reach.

    ``links`` has columns ``a`` and ``b`` of one orderable type; loops, repeats and nulls in them
    are ignored, an empty table gives an empty table. A round moves every node's larger neighbours
    to its smallest one and then the smaller ones likewise, so a chain settles in about log(n)
    rounds. Its result is a checkpoint, so the plan doesn't grow. Up to ``small`` links are
    contracted in one task instead.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = settled(ends.distinct()), None
    if edges.count() <= small:
        kind = dict(links.dtypes)["a"]
        return edges.groupBy().applyInPandas(_contracted, f"node {kind}, root {kind}")
    while True:
        # a table of stars has one edge per node that isn't a root, and no root among those
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).where("low < a").withColumnRenamed("a", "node")
        up = edges.join(least, F.col("b") == F.col("node"), "left").select("a", F.coalesce("low", "b").alias("b"))
        up = settled(up.distinct())
        down = up.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node")
        moved = up.join(down, F.col("a") == F.col("node")).where("b <> low")
        edges = settled(
            moved.select(F.col("b").alias("a"), F.col("low").alias("b")).union(down.select("node", "low")).distinct()
        )
