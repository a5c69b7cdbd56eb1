"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity, so whole signatures can't be
compared. The search is on containment instead. Items are parted by size; an item's signature is
the least of its shingles under one random order, as many as its size needs: a document that
holds a share t of q shingles misses at most q - ceil(t q) of them, so of one more than that it
must hold one. A document is asked with all its shingles, so its length costs no recall. Where
SIGNATURE shingles are fewer than that, a miss has probability (1 - t) ** SIGNATURE (1e-22).
Documents too small for a size part skip it. Candidates are verified on the words themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordHashes, blocks, joined, mixed, stored

WIDTH, THRESHOLD = 5, 0.8
SIGNATURE = 32
#: Shingles of the items that are held by a task at once; more items take more scans.
PART_SHINGLES = 1_000_000
_WORD = re.compile(r"\w+")


def cut_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], width: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


@dataclass(frozen=True)
class ItemIndex:
    """Signatures of the items by shingle width: sorted keys, the item of each, and the sizes."""

    ids: pa.Array
    words: list[list[str]]
    least: np.ndarray
    parts: dict[int, tuple[np.ndarray, np.ndarray]]
    threshold: float


def build_index(ids: pa.Array, texts: list[str], threshold: float = THRESHOLD, width: int = WIDTH) -> ItemIndex:
    """Items with fewer words than ``width`` are one shingle of their own width; wordless ones none.

    ``least`` is how many shingles a document must have for the size part (a power of two) of
    each item: the share ``threshold`` of the part's smallest item.
    """
    words = [cut_words(t) for t in texts]
    hashes = WordHashes()
    found: dict[int, list] = {}
    least = np.zeros(len(words), np.int64)
    for i, cut in enumerate(words):
        own = min(width, len(cut))
        if not own:
            continue
        keys = np.unique(_runs(hashes.of(cut), own))
        part = 1 << (len(keys).bit_length() - 1)
        least[i] = math.ceil(threshold * part - 1e-9)
        needed = len(keys) - math.ceil(threshold * len(keys) - 1e-9) + 1
        signature = keys[np.argsort(mixed(keys))[: min(needed, SIGNATURE)]]
        found.setdefault(own, []).append((signature, np.full(len(signature), i)))
    parts = {}
    for own, held in found.items():
        keys, item = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        parts[own] = (keys[order], item[order])
    return ItemIndex(ids, words, least, parts, threshold)


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on; the last width - 1 places have none."""
    out = words[: max(0, len(words) - width + 1)]
    for i in range(1, width):
        out = joined(out, words[i : len(words) - width + 1 + i])
    return mixed(out)


class _Search:
    """One task's search: a bit table in front of the sorted keys, and shingles of items met."""

    def __init__(self, index: ItemIndex):
        self.index, self.hashes = index, WordHashes()
        self.tables = {}
        for width, (keys, _) in index.parts.items():
            bits = max(12, min(24, int(len(keys)).bit_length() + 6))
            shift = np.uint64(64 - bits)
            table = np.zeros(1 << bits, bool)
            table[(keys >> shift).astype(np.int64)] = True
            self.tables[width] = (table, shift)
        self.met: dict[int, set] = {}

    def candidates(self, held: list[list[str]], lengths: np.ndarray) -> dict[int, set[int]]:
        """Items that share a signature shingle with each text, by the text's place."""
        found: dict[int, set[int]] = {}
        words = [self.hashes.of(w) for w in held]
        codes = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ends = np.cumsum(lengths)
        for width, (keys, item) in self.index.parts.items():
            asked = _runs(codes, width)
            table, shift = self.tables[width]
            at = np.flatnonzero(table[(asked >> shift).astype(np.int64)])
            owner = np.searchsorted(ends, at, side="right")
            inside = at + width <= ends[owner]
            at, owner = at[inside], owner[inside]
            first = np.searchsorted(keys, asked[at], side="left")
            last = np.searchsorted(keys, asked[at], side="right")
            for text, a, b in zip(owner[last > first], first[last > first], last[last > first]):
                found.setdefault(int(text), set()).update(item[a:b].tolist())
        return found

    def verified(self, words: list[str], items: set[int]) -> list[dict]:
        """Items that the text contains to the threshold, by exact shingles."""
        own: dict[int, set] = {}
        out = []
        for i in sorted(items):
            if len(words) < self.index.least[i]:
                continue
            cut = self.index.words[i]
            width = min(WIDTH, len(cut))
            if i not in self.met:
                if len(self.met) > 4_096:
                    self.met.clear()
                self.met[i] = shingles(cut, width)
            wanted = self.met[i]
            if width not in own:
                own[width] = shingles(words, width)
            shared = len(wanted & own[width])
            if shared >= self.index.threshold * len(wanted) - 1e-9:
                out.append((i, len(wanted), shared))
        return out


def items_within(text: Column, index: ItemIndex, id_type: str) -> Column:
    """The items that each text contains: an array of (item, n_shingles, n_shared).

    Null and wordless texts contain none. A document repeats nothing: an item counts once.
    """

    @F.arrow_udf(f"array<struct<item: {id_type}, n_shingles: bigint, n_shared: bigint>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = _Search(index)
        for texts in batches:
            rows, offsets = [], [0]
            for held, lengths in blocks(texts, lambda t: cut_words(t.as_py() or "")):
                near = search.candidates(held, lengths)
                for place, words in enumerate(held):
                    rows += search.verified(words, near[place]) if place in near else []
                    offsets.append(len(rows))
            item = index.ids.take(pa.array([r[0] for r in rows], pa.int64()))
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)]
            each = pa.StructArray.from_arrays([item, *counts], ["item", "n_shingles", "n_shared"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)

    return found(text)


def item_indexes(
    items: DataFrame, item_key: str = "item_id", text: str = "text", threshold: float = THRESHOLD,
    part_shingles: int = PART_SHINGLES,
) -> Iterator[ItemIndex]:
    """Indexes over parts of the items, each of about ``part_shingles`` shingles.

    A part is what is fetched and sent to the tasks at once, so its size is bounded however many
    items there are; a benchmark collection is usually one part.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = items.select(F.col(item_key).alias("id"), whole.alias("text"))
    size = F.length("text") / 4 + 1
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = max(1, math.ceil(total / part_shingles))
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(parts))
    for part in range(parts):
        held = rows.where(place == part).orderBy("id", "text").toArrow()
        if held.num_rows or parts == 1:
            yield build_index(held["id"].combine_chunks(), held["text"].to_pylist(), threshold)


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
    part_shingles: int = PART_SHINGLES,
) -> DataFrame:
    """``(key, item_key, n_shingles, n_shared, containment)``: documents that contain an item.

    Words are runs of letters, digits and underscores in lower case; shingles are sets of five
    words. One row per row of ``docs`` and item with containment of ``threshold`` or more. Null
    keys are kept as null; repeated rows each give their own.
    """
    id_type = items.schema[item_key].dataType.simpleString()
    out = None
    for index in item_indexes(items, item_key, item_text, threshold, part_shingles):
        hit = F.explode(items_within(F.col(text), index, id_type)).alias("hit")
        found = docs.select(F.col(key).alias(key), hit).select(
            key, F.col("hit.item").alias(item_key), "hit.n_shingles", "hit.n_shared",
            (F.col("hit.n_shared") / F.col("hit.n_shingles")).alias("containment"),
        )
        out = found if out is None else out.unionByName(found)
    return out


def without_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD, part_shingles: int = PART_SHINGLES,
) -> DataFrame:
    """The documents that contain no item, with all their columns; a filter in the scan."""
    id_type = items.schema[item_key].dataType.simpleString()
    kept = docs
    for n, index in enumerate(item_indexes(items, item_key, item_text, threshold, part_shingles)):
        if n:
            kept = stored(kept, "clean")
        kept = kept.where(F.size(items_within(F.col(text), index, id_type)) == 0)
    return kept
