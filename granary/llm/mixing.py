"""Mixing sources to target weights in fixed-length blocks.

Each source's documents are laid end to end in a hashed order and cut into blocks of ``length``
words. Every output shard draws multinomial counts of its slots by source. A source's slots are
numbered through all shards; slot i takes the block that a pseudorandom permutation of the
source's blocks, a new one for each full turn, has at i. Slots beyond a source's quota go to the
sources that fell short, so totals meet the targets. Blocks are joined by source and index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import stored, utf8
from granary.session import local_frame

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
LENGTH, SLOTS = 128, 1_024
#: Shards in one run of the numbering.
RUN_SHARDS = 4_096


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null. Counted on its bytes."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        out = []
        for raw in utf8(texts):
            b = np.frombuffer(raw, np.uint8)
            space = (b == 32) | ((b >= 9) & (b <= 13))
            out.append(int(np.count_nonzero(space[:-1] & ~space[1:]) + (len(b) > 0 and not space[0])))
        return pa.array(out, pa.int64())

    return counted(text)


def targets(
    sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST
) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources by code point, null last, take the weights in turn. What a full source can't take is
    shared by weight among the others, again and again until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    size = {s: float(n) for s, n in order}
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    total = share * sum(size.values())
    full: set = set()
    while True:
        left = total - sum(most * size[s] for s in full)
        free = sum(weight[s] for s in size if s not in full)
        got = {s: most * size[s] if s in full else left * weight[s] / free for s in size}
        over = {s for s in size if s not in full and got[s] > most * size[s]}
        if not over:
            return got
        full |= over


def laid_out(docs: DataFrame, key: str, source: str, text: str, carry: bool = False) -> DataFrame:
    """``(id, source, size, start)``: where each document begins in its source's row of words.

    The order is by hash, in as many runs as a run has documents: starts within a run, then starts
    of the runs, so a source with a third of all rows is no single task's work. ``carry`` keeps the text.
    """
    rows = docs.select(
        F.col(key).alias("id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), *([F.col(text).alias("text")] if carry else []),
    )
    runs = max(1, math.isqrt(docs.count()))
    place = F.xxhash64(F.col("id").cast("string"))
    rows = rows.withColumn("place", place).withColumn("run", F.pmod("place", F.lit(runs)))
    if not carry:
        rows = stored(rows, "sizes")
    before = Window.partitionBy("source", "run").orderBy("place", "id", "size", *(["text"] if carry else []))
    inner = F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1))
    runs_before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "run").agg(F.sum("size").alias("n"))
    starts = stored(
        starts.select(
            F.col("source").alias("of"), F.col("run").alias("at"),
            F.coalesce(F.sum("n").over(runs_before), F.lit(0)).alias("outer"),
        ),
        "starts",
    )
    rows = rows.withColumn("inner", F.coalesce(inner, F.lit(0)))
    joined = rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("at")))
    start = (F.col("inner") + F.col("outer")).alias("start")
    return joined.select("id", "source", "size", start, *(["text"] if carry else []))


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at places ``i``: a Feistel network, walked into range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 1 << 63, 4).astype(np.uint64)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mix = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(32)
            mix *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mix >> np.uint64(29)) & mask)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(i, np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _draws(plan: dict, shard: int) -> np.ndarray:
    """Multinomial counts of a shard's slots by source; the same on every run."""
    slots = min(plan["slots"], plan["total"] - shard * plan["slots"])
    rng = np.random.default_rng([plan["seed"], shard])
    return rng.multinomial(slots, plan["share"])


def _plan(sources: list[dict], length: int, slots: int, seed: int) -> dict:
    """Quotas of blocks near each target, at most MOST times what a source has."""
    blocks = np.array([-(-s["size"] // length) for s in sources], np.int64)
    quota = np.array(
        [
            min(int(MOST * b), round(s["target"] / (s["size"] / b))) if b else 0
            for s, b in zip(sources, blocks)
        ],
        np.int64,
    )
    total = int(quota.sum())
    share = quota / total if total else np.zeros(len(quota))
    return {"blocks": blocks, "quota": quota, "total": total, "share": share, "slots": slots, "seed": seed}


def drawn_slots(spark, sources: list[dict], length: int, slots: int, seed: int) -> DataFrame:
    """``(shard, slot, source_no, turn, block)``: which block each slot of each shard takes.

    Counts are drawn on the executors, shard by shard; their running totals are taken over runs
    of shards and then over the runs. Within a shard the slots are shuffled.
    """
    plan = _plan(sources, length, slots, seed)
    shards = -(-plan["total"] // slots)
    each = spark.range(0, shards, 1, max(1, min(shards, 1 + shards // 64))).withColumnRenamed("id", "shard")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            counts = np.concatenate([_draws(plan, int(s)) for s in ids]) if len(ids) else np.zeros(0, np.int64)
            n = len(plan["quota"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n)), pa.array(np.tile(np.arange(n), len(ids))), pa.array(counts)],
                ["shard", "source_no", "n"],
            )

    counts = each.mapInArrow(draw, "shard long, source_no long, n long")
    counts = stored(counts.withColumn("run", F.floor(F.col("shard") / RUN_SHARDS)), "draws")
    inner = Window.partitionBy("source_no", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("source_no", "run").agg(F.sum("n").alias("m"))
    runs = runs.select("source_no", "run", F.coalesce(F.sum("m").over(outer), F.lit(0)).alias("earlier"))
    numbered = counts.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(
        runs, ["source_no", "run"]
    )
    totals = {r["source_no"]: r["n"] for r in counts.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    drawn = np.array([totals.get(i, 0) for i in range(len(plan["quota"]))], np.int64)
    over = np.maximum(drawn - plan["quota"], 0)
    short = np.maximum(plan["quota"] - drawn, 0)
    over_before, short_before = np.cumsum(over) - over, np.cumsum(short) - short

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, no, n, first = (batch.column(k).to_numpy() for k in range(4))
            out_shard, out_no = np.repeat(shard, n), np.repeat(no, n)
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            beyond = i >= plan["quota"][out_no]
            j = over_before[out_no[beyond]] + i[beyond] - plan["quota"][out_no[beyond]]
            to = np.searchsorted(np.cumsum(short), j, side="right")
            i[beyond] = drawn[to] + j - short_before[to]
            out_no[beyond] = to
            size = plan["blocks"][out_no]
            turn = i // np.maximum(size, 1)
            block = np.empty(len(i), np.int64)
            key = out_no * 64 + turn
            for k in np.unique(key):
                at = key == k
                block[at] = permuted(i[at] % size[at], int(size[at][0]), [plan["seed"], int(k)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (out_shard, out_no, turn, block)],
                ["shard", "source_no", "turn", "block"],
            )

    numbered = numbered.select("shard", "source_no", "n", (F.col("within") + F.col("earlier")).alias("first"))
    dealt = numbered.mapInArrow(deal, "shard long, source_no long, turn long, block long")
    order = Window.partitionBy("shard").orderBy(
        F.xxhash64("shard", "source_no", "turn", "block", F.lit(seed)), "source_no", "turn", "block"
    )
    return dealt.withColumn("slot", F.row_number().over(order) - 1)


def source_table(places: DataFrame, share: float = SHARE) -> list[dict]:
    """Size and target of each source, in code point order, null last. Sources are few: bounded."""
    rows = places.groupBy("source").agg(F.sum("size").alias("size")).collect()
    if len(rows) > 1_000_000:
        raise ValueError("More than a million sources")
    sizes = [(r["source"], int(r["size"] or 0)) for r in rows]
    want = targets(sizes, share=share)
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    return [{"no": i, "source": s, "size": n, "target": want[s]} for i, (s, n) in enumerate(order)]


def _numbered(places: DataFrame, sources: list[dict]) -> DataFrame:
    """Places with the number, size and target of their source. The source table is small."""
    rows = [(s["source"], s["no"], s["size"], s["target"]) for s in sources]
    kinds = "of string, source_no long, source_size long, target double"
    table = local_frame(places.sparkSession, rows, kinds)
    return places.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("of"))).drop("of")


def taken_words(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    share: float = SHARE, length: int = LENGTH, slots: int = SLOTS, seed: int = 11,
) -> DataFrame:
    """``(key, size, source_size, target, taken)``, one row per document.

    ``taken`` is how many of its words the blocks of the mix hold, repeats counted. No block is
    drawn more than twice, so no document exceeds twice its size; documents without words have 0.
    A null source is a source of its own. Null and repeated keys keep a row each.
    """
    places = stored(laid_out(docs, key, source, text), "places")
    sources = source_table(places, share)
    places = stored(_numbered(places, sources), "numbered")
    drawn = drawn_slots(docs.sparkSession, sources, length, slots, seed)
    uses = stored(drawn.groupBy("source_no", "block").agg(F.count("*").alias("uses")), "uses")
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / length), F.floor((end - 1) / length)
    pieces = places.where("size > 0").select(
        "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block")
    )
    top = F.least(end, (F.col("block") + 1) * length)
    pieces = pieces.withColumn("words", top - F.greatest("start", F.col("block") * length))
    taken = pieces.join(uses, ["source_no", "block"]).groupBy("source_no", "start").agg(
        F.sum(F.col("words") * F.col("uses")).alias("taken")
    )
    taken = taken.select(F.col("source_no").alias("no"), F.col("start").alias("begin"), "taken")
    found = places.join(
        taken, (F.col("source_no") == F.col("no")) & (F.col("start") == F.col("begin")) & (F.col("size") > 0),
        "left",
    )
    return found.select(
        F.col("id").alias(key), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def packed_blocks(numbered: DataFrame, length: int) -> DataFrame:
    """``(source_no, block, ids, n_words, text)``: the words of each block, single-spaced.

    ``ids`` are the documents that the block's words come from, in order.
    """

    @F.arrow_udf("array<struct<block: bigint, at: bigint, words: bigint, piece: string>>")
    def cut(texts: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for raw, start in zip(utf8(texts), starts.to_pylist()):
            words, own = raw.split(), []
            i = 0
            while i < len(words):
                block, at = divmod(start + i, length)
                part = words[i : i + length - at]
                own.append((block, at, len(part), b" ".join(part).decode()))
                i += len(part)
            out.append(own)
        names = ("block", "at", "words", "piece")
        kind = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.string())))))
        return pa.array([[dict(zip(names, p)) for p in own] for own in out], kind)

    pieces = numbered.select("source_no", "id", F.explode(cut("text", "start")).alias("p")).select(
        "source_no", "p.block", F.struct("p.at", "p.words", "id", "p.piece").alias("part")
    )
    # a block has at most ``length`` words, so its list of parts is bounded
    parts = pieces.groupBy("source_no", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select(
        "source_no", "block", F.col("parts.id").alias("ids"),
        F.aggregate("parts.words", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_words"),
        F.array_join("parts.piece", " ").alias("text"),
    )


def mixed_blocks(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    share: float = SHARE, length: int = LENGTH, slots: int = SLOTS, seed: int = 11,
) -> DataFrame:
    """The mix itself: ``(shard, slot, source, turn, block, ids, n_words, text)``, a row per slot."""
    spark = docs.sparkSession
    sources = source_table(
        docs.select(F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), share
    )
    numbered = _numbered(laid_out(docs, key, source, text, carry=True), sources)
    drawn = stored(drawn_slots(spark, sources, length, slots, seed), "slots")
    names = local_frame(spark, [(s["no"], s["source"]) for s in sources], "no long, source string")
    found = packed_blocks(numbered, length).join(drawn, ["source_no", "block"])
    return found.join(F.broadcast(names), F.col("source_no") == F.col("no")).select(
        "shard", "slot", "source", "turn", "block", "ids", "n_words", "text"
    )
