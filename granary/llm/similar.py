"""Near-duplicates of a given similarity: MinHash bands find candidates, exact Jaccard decides.

The shingle set of a text is hashed ``BANDS * ROWS`` times and the least value of each hash kept.
Two sets of Jaccard similarity s agree on such a value with probability s, whatever their size,
so they share one of the bands of ``ROWS`` values with 1 - (1 - s ** ROWS) ** BANDS: 0.997 at 0.8
and above 0.9999 from 0.85 on, for short texts and long ones and for any number of documents.

Texts that share a band form a list. The shingle sets of its members are fetched and a link is
made only where the exact Jaccard similarity reaches the threshold. A list of many members or
shingles is cut into blocks and every pair of blocks compared: nothing is left out. A list gives
a forest of links, never its pairs; lists of the same members are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WordHashes, lowered, mixed, runs, stored, utf8
from granary.llm.components import components

BANDS, ROWS = 20, 6
#: Members of a list, or of a block of a longer one, and their shingles in all.
BLOCK, BLOCK_SHINGLES = 4_096, 2_000_000
_STEP = 1_024
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text."""
    return np.unique(runs(hashes.of(lowered(text)), width))


def mark_of(shingles: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band, from the least hashes of its rows; an empty set has none."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _STEP):
        part = mixed(shingles[i : i + _STEP])
        least = np.minimum(least, (_FACTORS[:, None] * part).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def roots_of(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, one set of its component under exact Jaccard similarity.

    Each set that is reached is compared with those not reached yet, so a family of near copies
    costs few rounds and no link is missed.
    """
    size = np.array([len(s) for s in sets], np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.split(place, np.cumsum(size)[:-1])
    root = np.full(len(sets), -1, np.int64)
    seen = np.zeros(len(values), bool)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first] = first
        reached = [first]
        while reached:
            at = reached.pop()
            low, high = size[at] * similarity - 1e-9, size[at] / similarity + 1e-9
            left = np.flatnonzero((root < 0) & (size >= low) & (size <= high))
            if not len(left):
                continue
            seen[place[at]] = True
            ends = np.cumsum(size[left])
            hits = np.concatenate([[0], np.cumsum(seen[np.concatenate([place[i] for i in left])])])
            seen[place[at]] = False
            both = hits[ends] - hits[ends - size[left]]
            near = left[both + 1e-9 >= similarity * (size[at] + size[left] - both)]
            root[near] = first
            reached += near.tolist()
    return root


def _prints(width: int):
    """Rows of (id, text) to the mark, the number of shingles, and the band keys of each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(7)
        for batch in batches:
            marks, sizes, keys = [], [], []
            for text in utf8(batch.column(1)):
                found = shingle_set(text, width, hashes)
                marks.append(mark_of(found))
                sizes.append(len(found))
                keys.append(band_keys(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "mark", "size", "bands"],
            )

    return made


def _sets(width: int):
    """Rows of (id, text) to the mark and the shingle set of each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(7)
        for batch in batches:
            for i, text in enumerate(utf8(batch.column(1))):
                found = shingle_set(text, width, hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1), pa.array([mark_of(found)], pa.binary()),
                        pa.array([found.astype("<u8").tobytes()], pa.binary()),
                    ],
                    ["id", "mark", "shingles"],
                )

    return made


def _linked(similarity: float):
    """The members of a list to a forest of links."""

    def found(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sets = [np.frombuffer(s.as_buffer(), "<u8") for s in group["shingles"]]
        root = roots_of(sets, similarity)
        apart = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": group["id"].take(pa.array(apart)), "b": group["id"].take(pa.array(root[apart]))})

    return found


def similar_documents(
    docs: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text",
    width: int = 5, block: int = BLOCK,
) -> DataFrame:
    """``(key, component_id)``, one row per row of ``docs``: groups of similar texts.

    Texts are linked if the sets of their ``width``-word shingles (words in lower case, split at
    ASCII space; a shorter text is one shingle) have a Jaccard similarity of ``similarity`` or
    more; a component is named by its smallest key. Null and empty texts are alike. A row with a
    null key takes the component of an equal set with a key, else null. Equal sets are folded first.
    """
    kind = dict(docs.select(F.col(key).alias("id")).dtypes)["id"]
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    prints = texts.mapInArrow(_prints(width), f"id {kind}, mark binary, size long, bands array<long>")
    prints = stored(prints, "prints")
    distinct = prints.groupBy("mark").agg(
        F.min("id").alias("id"), F.first("size").alias("size"), F.first("bands").alias("bands")
    )
    distinct = stored(distinct, "distinct")
    filed = distinct.where("id is not null").select("mark", "size", F.explode("bands").alias("band"))
    filed = stored(filed, "banded")
    counts = filed.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("total") / BLOCK_SHINGLES)).cast("int")
    counts = counts.select(F.col("band").alias("at"), F.least("n", blocks).cast("int").alias("blocks"))
    together = filed.join(counts, F.col("band") == F.col("at")).select("band", "mark", "blocks")
    members = F.sort_array(F.collect_list("mark")).alias("members")
    short = together.where("blocks = 1").groupBy("band").agg(members).select("members")
    own = F.pmod(F.xxhash64("mark"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    long = together.where("blocks > 1").withColumn("own", own).withColumn("other", other)
    long = long.groupBy("band", F.least("own", "other"), F.greatest("own", "other")).agg(members).select("members")
    lists = short.unionByName(long).where(F.size("members") > 1).distinct()
    lists = stored(lists.withColumn("list", F.monotonically_increasing_id()), "lists")
    wanted = stored(lists.select("list", F.explode("members").alias("member")), "wanted")
    # a set is fetched from the text of the key that names it; that key can have other texts
    marks = wanted.select("member").distinct()
    named_by = distinct.join(marks, F.col("mark") == F.col("member"), "left_semi")
    named_by = stored(named_by.select(F.col("id").alias("named"), F.col("mark").alias("asked")), "asked")
    fetched = texts.join(named_by.select("named").distinct(), F.col("id") == F.col("named"), "left_semi")
    sets = fetched.mapInArrow(_sets(width), f"id {kind}, mark binary, shingles binary")
    sets = sets.join(named_by, (F.col("id") == F.col("named")) & (F.col("mark") == F.col("asked")), "left_semi")
    sets = stored(sets.dropDuplicates(["mark"]), "sets")
    compared = wanted.join(sets, F.col("member") == F.col("mark")).select("list", "id", "shingles")
    links = compared.groupBy("list").applyInArrow(_linked(similarity), f"a {kind}, b {kind}")
    roots = components(links)
    named = distinct.join(roots, F.col("id") == F.col("node"), "left").select(
        "mark", F.coalesce("root", "id").alias("component_id")
    )
    return prints.select("id", "mark").join(stored(named, "named"), "mark").select(
        F.col("id").alias(key), "component_id"
    )


def one_of_each(docs: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that name their group, with all their columns, of any name: one row of each group.

    ``groups`` is ``(key, component_id)``. Of rows that share the key one stays. Rows with a null
    key can't be told apart by it and stay.
    """
    names = groups.where(F.col(key) == F.col("component_id")).select(F.col(key).alias("kept_key")).distinct()
    order = [F.xxhash64(c) for c in docs.columns if c != key]
    rows = docs.select(F.col(key).alias("own_key"), F.struct(*order or [key]).alias("place"), F.struct("*").alias("doc"))
    found = rows.join(stored(names, "kept"), F.col("own_key") == F.col("kept_key"), "left_semi")
    turn = F.row_number().over(Window.partitionBy("own_key").orderBy("place"))
    first = found.withColumn("turn", turn).where("turn = 1")
    return first.select("doc.*").unionByName(docs.where(F.col(key).isNull()))
