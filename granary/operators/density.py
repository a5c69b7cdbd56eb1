"""Density clusters of points in few dimensions through a grid.

Cells are eps / sqrt(d) wide, so points of one cell are within eps of each other: a cell of at
least ``min_samples`` points is core as a whole, without a distance. Only points of smaller cells
ask the cells around them, and of those a cell has fewer than ``min_samples``, so what they are
compared with grows with the number of points, not with its square.

Core points of a cell share a cluster, so the graph that is contracted has a node per cell. Two
cells are linked at once if a few outer points of each are close. Only pairs of cells that these
links leave in different clusters are compared point by point, and only on the points within eps
of the other cell's box. Points of a cell are dealt over blocks, so a cell that holds a third of
the table is spread over many tasks.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.components import components
from granary.session import looked_up, settled

#: Most dimensions whose cells around a cell are listed, and the farthest cell from 0.
MAX_DIMENSIONS, MAX_CELL = 4, 1 << 31
#: Points of a cell that one task compares.
BLOCK = 2_000
#: Room for rounding in the place of a point in its cell.
SLACK = 1e-6


def _distance(left: str, right: str, d: int) -> Column:
    return F.sqrt(sum((F.col(f"{left}{i}") - F.col(f"{right}{i}")) ** 2 for i in range(d)))


def offsets(d: int) -> list[tuple[int, ...]]:
    """The cells around a cell that can hold a point within eps of one of its points."""
    reach = math.ceil(math.sqrt(d)) + 1
    near = itertools.product(range(-reach, reach + 1), repeat=d)
    return [o for o in near if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= d * (1 + 4 * SLACK)]


def _around(df: DataFrame, d: int, steps: list[tuple[int, ...]]) -> DataFrame:
    """A row per cell around a row's own, in ``c0..``."""
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in steps]))
    moved = df.withColumn("step", each)
    return moved.withColumns({f"c{i}": F.col(f"c{i}") + F.col(f"step.o{i}") for i in range(d)}).drop("step")


def _pieces(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _block(n: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(29), "key"), _pieces(n)).cast("int")


def _every_block(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), _pieces(n) - 1))


def _gap(low: str, high: str, other_low: str, other_high: str, d: int) -> Column:
    """Distance of two boxes, or of a point and a box."""
    sides = [
        F.greatest(F.col(f"{low}{i}") - F.col(f"{other_high}{i}"), F.col(f"{other_low}{i}") - F.col(f"{high}{i}"), F.lit(0.0))
        for i in range(d)
    ]
    return F.sqrt(sum(s * s for s in sides))


def grid_labels(folded: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    """``(vec, cluster, is_core)`` for distinct vectors ``(vec, key, weight)`` of ``d`` dimensions.

    Clusters are named by their smallest core key, noise is -1; a point that isn't core joins the
    smallest cluster among its core neighbours. Vectors that are null, of another length or not
    finite are noise and count for no other point.
    """
    numbers, cell = range(d), [f"c{i}" for i in range(d)]
    width = eps / math.sqrt(d) * (1 - SLACK)
    finite = (F.size("vec") == d) & F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < math.inf))
    points = folded.where(finite).withColumns({f"x{i}": F.get("vec", F.lit(i)) for i in numbers})
    points = points.withColumns({f"c{i}": F.floor(F.col(f"x{i}") / width).cast("long") for i in numbers})
    points = points.select("key", "weight", *[f"x{i}" for i in numbers], *cell)
    cells = settled(points.groupBy(*cell).agg(F.sum("weight").alias("held"), F.count("*").alias("n")))
    points = looked_up(points, cells, cell, "key", 4 * BLOCK)

    near = _near_counts(points, cells, d, eps, min_samples)
    dense = (F.col("held") >= min_samples) | (F.coalesce("near", F.lit(0)) >= min_samples)
    points = settled(points.join(near, "key", "left").withColumn("is_core", dense).drop("near", "n", "held"))
    core = points.where("is_core").drop("is_core", "weight")
    named = _named_cells(core, d, eps)

    labels = looked_up(core, named.select(*cell, "n", "cluster"), cell, "key", 4 * BLOCK)
    border = points.where("not is_core").select("key", *[F.col(f"x{i}").alias(f"y{i}") for i in numbers], *cell)
    asked = _around(border, d, offsets(d)).join(named.select(*cell, "n", "cluster"), cell)
    asked = asked.withColumn("block", _every_block("n")).withColumnRenamed("key", "asker")
    hosts = labels.withColumn("block", _block("n")).drop("cluster", "n", "key")
    met = asked.join(hosts, [*cell, "block"]).where(_distance("y", "x", d) <= eps)
    joined = met.groupBy("asker").agg(F.min("cluster").alias("cluster"))
    found = labels.select("key", "cluster", F.lit(True).alias("is_core")).union(
        joined.select("asker", "cluster", F.lit(False))
    )
    return folded.select("vec", "key").join(found, "key", "left").select(
        "vec", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core")
    )


def _near_counts(points: DataFrame, cells: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    """``(key, near)``: the points within eps of each point of a cell that isn't core as a whole."""
    cell = [f"c{i}" for i in range(d)]
    few = points.where(F.col("held") < min_samples)
    few = few.select(F.col("key").alias("asker"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(d)], *cell)
    asked = _around(few, d, offsets(d)).join(cells.select(*cell, "n"), cell)
    asked = asked.withColumn("block", _every_block("n")).drop("n")
    hosts = points.withColumn("block", _block("n")).drop("n", "held", "key")
    met = asked.join(hosts, [*cell, "block"]).where(_distance("y", "x", d) <= eps)
    return met.groupBy(F.col("asker").alias("key")).agg(F.sum("weight").alias("near"))


def _named_cells(core: DataFrame, d: int, eps: float) -> DataFrame:
    """Cells with core points: their count ``n`` and ``cluster``, the smallest core key reachable."""
    numbers, cell = range(d), [f"c{i}" for i in range(d)]
    point = F.struct(*[F.col(f"x{i}") for i in numbers])
    outer = [pick(point, F.col(f"x{i}")) for i in numbers for pick in (F.min_by, F.max_by)]
    boxes = [f(f"x{i}").alias(f"{name}{i}") for i in numbers for name, f in (("low", F.min), ("high", F.max))]
    cells = settled(
        core.groupBy(*cell).agg(
            F.min("key").alias("low"), F.count("*").alias("n"), F.array(*outer).alias("outer"), *boxes
        )
    )
    later = [o for o in offsets(d) if o > (0,) * d]
    other = cells.select(*cell, *[F.col(c).alias(f"to_{c}") for c in cells.columns if c not in cell])
    pairs = _around(cells.withColumns({f"a{i}": F.col(f"c{i}") for i in numbers}), d, later).join(other, cell)
    pairs = pairs.where(_gap("low", "high", "to_low", "to_high", d) <= eps * (1 + SLACK))

    def close(a, b):
        return F.sqrt(sum((a[f"x{i}"] - b[f"x{i}"]) ** 2 for i in numbers)) <= eps

    linked = F.exists("outer", lambda a: F.exists("to_outer", lambda b: close(a, b)))
    pairs = settled(pairs.withColumn("linked", linked).drop("outer", "to_outer"))
    links = pairs.where("linked").select(F.col("low").alias("a"), F.col("to_low").alias("b"))
    roots = settled(components(links))
    # pairs of cells that are still in different clusters are compared on their points
    left = roots.select(F.col("node").alias("low"), F.col("root").alias("root_a"))
    right = roots.select(F.col("node").alias("to_low"), F.col("root").alias("root_b"))
    open_pairs = pairs.where("not linked").join(left, "low", "left").join(right, "to_low", "left")
    apart = F.coalesce("root_a", "low") != F.coalesce("root_b", "to_low")
    open_pairs = settled(open_pairs.where(apart))
    if not open_pairs.isEmpty():
        roots = components(links.union(_close_pairs(core, open_pairs, cells, d, eps)))
    return settled(
        cells.join(roots, F.col("low") == F.col("node"), "left").select(
            *cell, "n", F.coalesce("root", "low").alias("cluster")
        )
    )


def _close_pairs(core: DataFrame, pairs: DataFrame, cells: DataFrame, d: int, eps: float) -> DataFrame:
    """``(a, b)``: the pairs of cells of which some points are within eps of each other."""
    numbers, cell = range(d), [f"c{i}" for i in range(d)]
    points = looked_up(core, cells.select(*cell, "n"), cell, "key", 4 * BLOCK).withColumn("block", _block("n")).drop("n")

    def side(own: list[str], n: str, other_n: str, other: str, name: str) -> DataFrame:
        """A side's points near the other cell's box, in own blocks, once for each of the other's."""
        asked = pairs.select(
            F.col("low").alias("a"), F.col("to_low").alias("b"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(own)],
            F.col(n).alias("own"), F.col(other_n).alias("others"),
            *[F.col(f"{other}low{i}").alias(f"l{i}") for i in numbers], *[F.col(f"{other}high{i}").alias(f"h{i}") for i in numbers],
        )
        asked = asked.withColumn("block", _every_block("own"))
        met = asked.join(points, [*cell, "block"]).where(_gap("x", "x", "l", "h", d) <= eps * (1 + SLACK))
        met = met.withColumn("across", _every_block("others"))
        blocks = ("block", "across") if name == "x" else ("across", "block")
        return met.select(
            "a", "b", F.col(blocks[0]).alias("i"), F.col(blocks[1]).alias("j"),
            *[F.col(f"x{i}").alias(f"{name}{i}") for i in numbers],
        )

    left = side([f"a{i}" for i in numbers], "n", "to_n", "to_", "x")
    right = side(cell, "to_n", "n", "", "y")
    met = left.join(right, ["a", "b", "i", "j"]).where(_distance("x", "y", d) <= eps)
    return met.select("a", "b").distinct()
