"""SimHash near-duplicates through segment bit counts.

A fingerprint is cut into equal segments and mapped to the bit count of each. The Manhattan
distance of two such points is at most the Hamming distance of the fingerprints, so all partners
within two bits lie within two steps on the grid of counts. Two points within two steps share a
grid point within one step of each: every fingerprint is filed under its own point and those one
step away, and only fingerprints filed together are compared bit by bit.

A grid point that holds many fingerprints (families of near copies) is searched again on the grid
of single bits, where one point is near 65 fingerprints at most. So no list is unbounded and
nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import lowered, stored, utf8
from granary.llm.components import components

SEED = 42
RADIUS = 2
#: Fingerprints of one grid point that are compared directly.
LIST_LIMIT = 512
#: Distinct fingerprints up to which 16 segments are used; beyond, 32 keep the lists short.
COARSE_LIMIT = 1 << 23


def fingerprint_of(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """64 bits as a signed integer; bit i is set if over half of the shingles' hashes have it."""
    words = lowered(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist())
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - last)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8").astype(np.int64)[0])


def fingerprint(text: Column, width: int = 3, seed: int = SEED) -> Column:
    """The fingerprint of a text column; of null and empty texts it is 0."""

    @F.arrow_udf("long")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, width, seed) for t in utf8(texts)], pa.int64())

    return made(text)


def grid_points(fp: str, segments: int) -> Column:
    """The point of segment bit counts of a fingerprint and all points one step from it, packed."""
    width = 64 // segments
    room = 64 // segments if segments != 16 else 3
    mask = f"{(1 << width) - 1}L" if width < 64 else "-1L"
    each = f"sequence(0, {segments - 1})"
    count = f"cast(bit_count(shiftrightunsigned({fp}, i * {width}) & {mask}) as bigint)"
    point = f"aggregate({each}, 0L, (p, i) -> p | shiftleft({count}, i * {room}))"
    rest = f"(p & ~shiftleft({(1 << room) - 1}L, i * {room}))"
    moves = (
        f"filter(array(if({count} < {width}, {rest} | shiftleft({count} + 1, i * {room}), null), "
        f"if({count} > 0, {rest} | shiftleft({count} - 1, i * {room}), null)), x -> x is not null)"
    )
    return F.expr(
        f"flatten(transform(array({point}), p -> "
        f"concat(array(p), flatten(transform({each}, i -> {moves})))))"
    )


def forest(near: np.ndarray) -> np.ndarray:
    """The smallest index that each index of a symmetric matrix of links reaches."""
    n = len(near)
    label = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        lower = np.where(near, label[None, :], n).min(axis=1)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            return label
        label = lower


def _links_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of (fp, id) to links that connect exactly what two bits or fewer connect."""
    for batch in batches:
        a, b = [], []
        for value in batch.column(0):
            members = sorted(value.as_py(), key=lambda m: m["id"])
            fps = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
            near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
            root = forest(near)
            for i in np.flatnonzero(root != np.arange(len(root))):
                a.append(members[i]["id"])
                b.append(members[root[i]]["id"])
        kind = batch.schema.field(0).type.value_type.field("id").type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])


def fingerprint_links(prints: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """``(a, b)`` over ids of distinct fingerprints ``(fp, id)``: what two or fewer bits link.

    Links within a list are thinned to a forest, which keeps every component whole. A smaller
    ``list_limit`` sends more points to the finer grid; it doesn't change what is connected.
    """
    kind = dict(prints.dtypes)["id"]
    segments = 16 if prints.count() <= COARSE_LIMIT else 32
    filed = prints.select("fp", "id", F.explode(grid_points("fp", segments)).alias("point"))
    shared = stored(
        filed.groupBy("point").agg(F.count("*").alias("n")).where("n > 1"), "points"
    )
    together = stored(filed.join(shared, "point"), "filed")
    member = F.collect_list(F.struct("fp", "id")).alias("members")
    lists = together.where(F.col("n") <= list_limit).groupBy("point").agg(member).select("members")
    light = lists.mapInArrow(_links_of_lists, f"a {kind}, b {kind}")
    crowded = together.where(F.col("n") > list_limit).select("fp", "id").distinct()
    fine = crowded.select("fp", "id", F.explode(grid_points("fp", 64)).alias("point"))
    # all within one bit of a point are within two bits of each other
    fine = fine.groupBy("point").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1)
    heavy = fine.select(F.explode("ids").alias("a"), F.array_min("ids").alias("b")).where("a <> b")
    return light.union(heavy)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3,
    list_limit: int = LIST_LIMIT,
) -> DataFrame:
    """``(key, fingerprint long, component_id)``, one row per row of ``docs``.

    Fingerprints link at two or fewer differing bits; a component is named by the smallest key it
    holds. Null and empty texts have fingerprint 0 and link like any other; equal keys keep a row
    each. A row with a null key takes its fingerprint's component, or null if none has a key.
    Equal fingerprints are folded first, so copies cost nothing further.
    """
    prints = stored(
        docs.select(F.col(key).alias("id"), fingerprint(F.col(text), width).alias("fp")), "prints"
    )
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    roots = components(fingerprint_links(distinct.where("id is not null"), list_limit))
    named = distinct.join(roots, distinct["id"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "id").alias("component_id")
    )
    return prints.join(stored(named, "named"), "fp").select(
        F.col("id").alias(key), F.col("fp").alias("fingerprint"), "component_id"
    )
