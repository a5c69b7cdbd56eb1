import hashlib
import random

import pytest
from pyspark.sql import functions as F

from granary.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(convs):
    """Rows of the trie from {conv: [(role, text), ...]} by walking all prefixes."""
    nodes = {}
    for conv, said in convs.items():
        for depth in range(len(said) + 1):
            nodes.setdefault(tuple(said[:depth]), []).append(conv)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        fan = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in under}
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(fan[path]),
            sum(not f for f in fan.values()), sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out)


def built(spark, rows, **kind):
    frame = spark.createDataFrame(rows, TURNS).withColumn("id", F.lit(3)).withColumn("range", F.lit("x"))
    placed = trie.in_order(trie.turn_ids(frame.repartition(3)))
    every = spark.createDataFrame([(900,), (None,), (1,), (1,)], "conv long").union(placed.select("conv"))
    found = trie.prefix_trie(placed, every, **kind)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("kind", [{"width": 1, "children": 2, "list_bits": 2}, {}])
def test_trie_equals_brute_force(spark, kind):
    rng = random.Random(3)
    convs = {c: [(rng.choice("ua"), rng.choice(["", "x", "long text"])) for _ in range(rng.randint(1, 9))] for c in range(40)}
    shared = [("u", "hot"), ("a", "reply"), ("u", ""), ("a", "é😀")]
    convs |= {c: shared[: c % 5] + convs[c % 40][: c % 3] for c in range(100, 140)}
    convs |= {-5: shared, 800: [("u", str(i)) for i in range(17)], 801: [("u", str(i)) for i in range(13)]}
    rows = [(c, i, r, t) for c, said in convs.items() for i, (r, t) in enumerate(said)]
    expected = plain_trie({c: said for c, said in convs.items() if said} | {900: []})
    assert built(spark, rows, **kind) == expected


def test_odd_turns(spark):
    rows = [(1, None, "u", None), (1, 0, None, "b"), (1, 5, "u", ""), (2, 1, "u", ""), (2, 1, "u", ""), (None, 1, "u", "none")]
    rows += [(3, None, "u", "x" * 100_000)]
    convs = {1: [("u", ""), ("", "b"), ("u", "")], 2: [("u", "")] * 2, 3: [("u", "x" * 100_000)], 900: []}
    assert built(spark, rows) == plain_trie(convs)
    placed = trie.in_order(trie.turn_ids(spark.createDataFrame([], TURNS)))
    assert trie.prefix_trie(placed, placed.select("conv")).count() == 0


def test_places_of_a_hot_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"), F.lit(1).alias("v"))
    found = trie.ranked(rows.repartition(7), "k", [F.col("v")], {"upto": "v"}).where("k = -1")
    assert found.agg(F.countDistinct("place"), F.max("place"), F.min("place"), F.max("upto")).first() == (13_333, 13_333, 1, 13_333)
