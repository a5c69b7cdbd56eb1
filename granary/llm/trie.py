"""Prefix trie of conversations by ROLLUP over columns of turn ids.

Each turn gets an id from its role and text. A conversation becomes blocks of ``WIDTH`` turn-id
columns; a block is keyed by the node where the block before it ended, and the last block may be
empty. One GROUP BY of that key with ROLLUP over the columns gives all prefixes of all
conversations together: ``grouping_id`` says how many turns of the block a group has fixed, and a
group whose last fixed turn is missing is no node.

The node before a block is named by a digest of all turns before it, made for all blocks of a
conversation at once by a prefix scan (up over pairs of blocks, then down), so a conversation of
n turns takes about 2 log(n / WIDTH) joins however long it is. Turns are ranked by a range sort
with counts per range. So no conversation, prefix or list of members is held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import looked_up, stored

#: Turn-id columns of a block.
WIDTH = 4
#: Children of a node whose rows travel to one task; more are dealt out.
CHILDREN = 10_000
#: Conversation ids of one list: ids that agree but for these low bits.
LIST_BITS = 12


def ranked(rows: DataFrame, key: str, order: list[Column], adds: dict[str, str] | None = None) -> DataFrame:
    """The rows with ``place`` (1, 2, ... within ``key`` by ``order``) and running totals.

    ``adds`` maps the name of a running total, itself included, to the column it sums. Rows are
    sorted over ranges, numbered in each range, and shifted by the counts of the ranges before,
    so a key with a large share of all rows is spread like any others. Rows equal in ``key`` and
    ``order`` take places in any order.
    """
    adds = adds or {}
    mixed = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = mixed.repartitionByRange(F.col(key), *order, F.col("tie"))
    dealt = stored(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    names = ["place", *adds]
    sums = [F.sum(column).alias(f"{name}_here") for name, column in adds.items()]
    pieces = dealt.groupBy(key, "range").agg(F.count("*").alias("place_here"), *sums)
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"{n}_here").over(earlier), F.lit(0)).alias(f"{n}_before") for n in names]
    within = Window.partitionBy(key, "range").orderBy(*order, "tie")
    numbered = dealt.withColumn("place", F.row_number().over(within).cast("long"))
    for name, column in adds.items():
        numbered = numbered.withColumn(name, F.sum(column).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.join(pieces.select(key, "range", *before), [key, "range"])
    totals = [(F.col(n) + F.col(f"{n}_before")).alias(n) for n in names]
    return joined.select(*[c for c in rows.columns if c not in names], *totals)


def turn_ids(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, id, chars)``: a digest of role and text for each turn, and its code points.

    Null roles and texts are empty. Rows with a null key belong to no conversation and are left out.
    """
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    whole = F.concat(F.length(who).cast("string"), F.lit(":"), who, said)
    return turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("id"), F.length(said).cast("long").alias("chars"),
    )


def in_order(ids: DataFrame) -> DataFrame:
    """``(conv, id, chars, place)``: turns numbered from 1 by turn, null first, then by their ids."""
    return ranked(ids, "conv", [F.col("turn").asc_nulls_first(), F.col("id")]).drop("turn")


def _digest(*parts: str | Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _with_prior(blocks: DataFrame, most: int) -> DataFrame:
    """Blocks with ``prior``: a digest of all turns of the blocks before, up to block ``most``.

    Upwards the digests of two neighbours become one of both; downwards a pair hands the digest of
    all before it to its left half, and that joined with the left half's to its right half.
    """
    odd = F.col("block") % 2 == 1
    levels = [blocks.select("conv", "block", "own")]
    while most >> (len(levels) - 1):
        pairs = levels[-1].groupBy("conv", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(~odd, F.col("own"))).alias("left"), F.max(F.when(odd, F.col("own"))).alias("right")
        )
        both = F.when(F.col("right").isNotNull(), _digest("left", "right")).otherwise(F.col("left"))
        levels.append(stored(pairs.select("conv", "block", both.alias("own")), "up"))
    prior = levels[-1].select("conv", "block", _digest(F.lit(b"")).alias("prior"))
    for level in reversed(levels[:-1]):
        pair = F.shiftright("block", 1).alias("pair")
        above = prior.select("conv", F.col("block").alias("pair"), "prior")
        left = level.where(~odd).select("conv", pair, F.col("own").alias("left"))
        halves = level.select("conv", "block", pair).join(above, ["conv", "pair"]).join(left, ["conv", "pair"])
        own = F.when(odd, _digest("prior", "left")).otherwise(F.col("prior"))
        prior = stored(halves.select("conv", "block", own.alias("prior")), "down")
    return blocks.drop("own").join(prior, ["conv", "block"])


def turn_blocks(placed: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """``(conv, block, t1.., c1.., size, prior)``: each conversation's turns in blocks of ids and chars.

    Where turns fill their blocks, an empty one follows, so a conversation ends in its only block
    of fewer than ``width`` turns.
    """
    place, numbers = F.col("place") - 1, range(width)
    ids = [F.max(F.when(place % width == i, F.col("id"))).alias(f"t{i + 1}") for i in numbers]
    chars = [F.max(F.when(place % width == i, F.col("chars"))).alias(f"c{i + 1}") for i in numbers]
    block = F.floor(place / width).alias("block")
    filled = placed.groupBy("conv", block).agg(*ids, *chars, F.count("*").alias("size"))
    turns = placed.groupBy("conv").agg(F.count("*").alias("turns"))
    ending = convs.join(turns, "conv", "left").select("conv", F.coalesce("turns", F.lit(0)).alias("turns"))
    nothing = [F.lit(None).cast("binary")] * width + [F.lit(None).cast("long")] * width
    empty = ending.where(F.col("turns") % width == 0).select(
        "conv", F.floor(F.col("turns") / width), *nothing, F.lit(0).cast("long")
    )
    own = _digest(*[F.coalesce(f"t{i + 1}", F.lit(b"")) for i in numbers])
    blocks = stored(filled.union(empty).withColumn("own", own), "blocks")
    most = blocks.agg(F.max("block")).first()[0] or 0
    return stored(_with_prior(blocks, most), "keyed")


def _rolled_up(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """All prefixes of the blocks together: a row per group of equal ``prior`` and first turns."""
    ids = [f"t{i + 1}" for i in range(width)]
    grouped = blocks.sparkSession.sql(
        f"select block, prior, {', '.join(ids)}, {width} - bit_count(grouping_id()) as level, min(conv) as conv_id, {sums} "
        f"from {{blocks}} group by block, prior, rollup ({', '.join(ids)})",
        blocks=blocks,
    )
    # a group whose last turn is missing gathers conversations that ended before it
    there = F.expr(f"level = 0 or element_at(array({', '.join(ids)}), level) is not null")
    return grouped.where(there).withColumn("depth", F.col("block") * width + F.col("level"))


def _ends(blocks: DataFrame, width: int, list_bits: int) -> DataFrame:
    """``(key, ends_sha256)``: the digest of the ids of the conversations that end at each node.

    Ids are distinct, so a list of those that agree but for ``list_bits`` low bits is bounded; a
    task then feeds the lists of a node in order to one digest and holds a list at a time.
    """
    ids = [F.coalesce(f"t{i + 1}", F.lit(b"")) for i in range(width)]
    ending = blocks.where(F.col("size") < width).select("conv", _digest("prior", *ids).alias("key"))
    lists = ending.groupBy("key", F.shiftright("conv", list_bits).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, None, []
        for batch in batches:
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != key:
                    if key is not None:
                        out.append((key, held.hexdigest()))
                    key, held = now, hashlib.sha256(ids.encode())
                else:
                    held.update(f",{ids}".encode())
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in out], "ends_sha256": [d for _, d in out]}, shape)
            out = []
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [held.hexdigest()]}, shape)

    shape = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    dealt = lists.repartition("key").sortWithinPartitions("key", "part").select("key", "ids")
    return dealt.mapInArrow(digests, "key binary, ends_sha256 string")


def prefix_trie(
    placed: DataFrame, convs: DataFrame, width: int = WIDTH, children: int = CHILDREN, list_bits: int = LIST_BITS
) -> DataFrame:
    """One row per node of the trie of ``placed`` turns ``(conv long, place, id, chars)``.

    ``place`` counts a conversation's turns from 1; ``convs`` (a column ``conv``) names all
    conversations, also those without turns, which are members of the root only; repeats and nulls
    in it are ignored. Columns: ``conv_id`` (the smallest member) and ``depth``, which name a node,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256`` (of the members that end here, in ascending order, with
    commas between). Without conversations there is no node.

    A subtree's sums come from its members: each node counts for its smallest member, whose other
    nodes above the subtree are taken off again by a running total over its nodes by depth.
    """
    blocks = turn_blocks(placed, convs.where("conv is not null").select("conv").distinct(), width)
    chars = ", ".join(f"max(c{i + 1})" for i in range(width))
    rolled = _rolled_up(blocks, width, f"count(*) as n_convs, array({chars}) as chars")
    ids = [F.coalesce(f"t{i + 1}", F.lit(b"")) for i in range(width)]
    upper = [F.when(F.col("level") > i + 1, t).otherwise(F.lit(b"")) for i, t in enumerate(ids)]
    groups = stored(
        rolled.select(
            "conv_id", "depth", "block", "level", "n_convs", _digest("prior", *ids).alias("key"),
            F.when(F.col("level") > 0, _digest("prior", *upper)).alias("parent"),
            F.expr("if(level = 0, 0, (n_convs - 1) * element_at(chars, level))").alias("saved"),
        ),
        "groups",
    )
    # the group of no turns of a later block is the node that ended the block before
    nodes = groups.where("level > 0 or block = 0").select("conv_id", "depth", "n_convs", "key", "parent", "saved")
    counted = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"))
    above = groups.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("parent_depth"))
    parents = stored(counted.join(above, "parent"), "parents")
    limit = max(children, nodes.count() // 4096)
    linked = looked_up(nodes, parents.select("parent", "n", "parent_conv_id"), ["parent"], "key", limit)
    fanned = parents.select(F.col("parent_conv_id").alias("conv_id"), F.col("parent_depth").alias("depth"), F.col("n").alias("n_children"))
    linked = linked.drop("n", "parent", "key").join(fanned, ["conv_id", "depth"], "left")
    linked = stored(linked.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    named = linked.groupBy("conv_id").agg(
        F.sum("saved").alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    held = blocks.groupBy("conv").agg(F.count("*").alias("n"))
    named = named.withColumnRenamed("conv_id", "conv").join(held, "conv")
    sums = "coalesce(sum(own), 0) as saved_below, coalesce(sum(leaf), 0) as n_leaves"
    counted_blocks = stored(looked_up(blocks.drop("size"), named, ["conv"], "block", limit), "counted")
    below = _rolled_up(counted_blocks, width, sums).where("level > 0 or block = 0").select(
        "conv_id", "depth", "saved_below", "n_leaves"
    )
    ends = _ends(blocks, width, list_bits).join(groups.select("key", "conv_id", "depth"), "key").drop("key")
    running = ranked(linked, "conv_id", [F.col("depth")], {"until": "saved"}).drop("place")
    return running.join(below, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("saved_below") - F.col("until") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
