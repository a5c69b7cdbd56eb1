"""Ranked lexical search: the best documents for each item, by groups of matched terms.

Each task indexes its documents by the items' terms. For an item, the postings of its terms set
one bit each in the documents' presence masks; documents of equal mask form a group. A mask
bounds the score of its group from above by the largest contribution that each of its terms has
here. Groups are evaluated exactly by descending bound, until the bound is below the k-th best
score that the task has found for the item, in this or an earlier block of documents. No
document that is left out can be among the best, so the result is exact.

The best k of every task are merged in one ranking per item. Items come in blocks of bounded
vocabulary, each with one scan of the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import LOWER, UPPER, stored, utf8

#: Terms of the items that are searched for at once, about; more items take more scans.
BLOCK_TERMS = 1_000_000
#: Bytes of a text that are cut into terms at once, and postings that are searched at once.
PIECE, BLOCK_POSTINGS = 1 << 22, 4_000_000

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLDED = bytes.maketrans(_SEPARATORS + UPPER.encode(), b" " * len(_SEPARATORS) + LOWER.encode())


def cut_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists: runs of ASCII letters and digits (A-Z lowered) and of
    all that is not ASCII."""
    folded, start = text.translate(_FOLDED), 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def index_documents(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(id, n, terms, tfs)``: the length of each document, its terms of the vocabulary and their
    occurrences."""
    kind = docs.schema[key].dataType.simpleString()

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, offsets, terms, tfs = [], [0], [], []
            for value in utf8(batch.column(1)):
                held, n = Counter(), 0
                for words in cut_terms(value):
                    n += len(words)
                    held.update(filter(vocabulary.__contains__, words))
                lengths.append(n)
                terms += map(vocabulary.__getitem__, held)
                tfs += held.values()
                offsets.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "tfs"]
            )

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        indexed, f"id {kind}, n long, terms array<int>, tfs array<int>"
    )


@dataclass(frozen=True)
class Queries:
    """Items of a block: the terms of each, and the weight of each times its repeats in the item."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    documents: int
    tokens: int
    k: int


class _Best:
    """The best documents of a task for each item: scores and ids, highest first, then least id."""

    def __init__(self, queries: Queries, kind: pa.DataType):
        self.queries = queries
        self.scores = [np.zeros(0, np.int64) for _ in queries.terms]
        self.ids = [pa.array([], kind) for _ in queries.terms]

    def least(self, item: int) -> int:
        """The score that a further document must reach at least."""
        held = self.scores[item]
        return int(held[-1]) if len(held) == self.queries.k else 1

    def add(self, item: int, scores: np.ndarray, ids: pa.Array) -> None:
        scores = np.concatenate([self.scores[item], scores])
        ids = pa.concat_arrays([self.ids[item], ids])
        ranks = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="min").to_numpy().astype(np.int64)
        order = np.lexsort((ranks, -scores))[: self.queries.k]
        self.scores[item], self.ids[item] = scores[order], ids.take(pa.array(order))


class _Block:
    """Documents of one block by term, with what each occurrence adds to a score for weight 1."""

    def __init__(self, batch: pa.RecordBatch, queries: Queries):
        self.ids = batch.column(0)
        n = batch.column(1).to_numpy()
        lists = batch.column(2)
        sizes = pc.list_value_length(lists).to_numpy()
        terms = lists.flatten().to_numpy().astype(np.int64)
        tf = batch.column(3).flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(n)), sizes)
        m = 100 - 25 + (25 * n * queries.documents) // max(1, queries.tokens)
        order = np.argsort(terms, kind="stable")
        self.n, self.owner = len(n), owner[order]
        self.adds = ((1_000_000_000 * tf) // (1000 * tf + 12 * m[owner]))[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.most = np.maximum.reduceat(self.adds, self.starts) if len(order) else self.adds

    def search(self, item: int, queries: Queries, best: _Best) -> None:
        at = np.searchsorted(self.terms, queries.terms[item])
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == queries.terms[item][here]
        at, weights = at[here], queries.weights[item][here]
        if not len(at):
            return
        masks = np.zeros((self.n, (len(at) + 63) // 64), np.uint64)
        for bit, term in enumerate(at):
            masks[self.owner[self.starts[term] : self.ends[term]], bit >> 6] |= np.uint64(1 << (bit & 63))
        docs = np.flatnonzero(masks.any(axis=1))
        found, group = np.unique(masks[docs], axis=0, return_inverse=True)
        bounds = np.zeros(len(found), np.int64)
        for bit, term in enumerate(at):
            has = (found[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)
            bounds += has.astype(np.int64) * (weights[bit] * self.most[term])
        by_group = docs[np.argsort(group.ravel(), kind="stable")]
        last = np.cumsum(np.bincount(group.ravel(), minlength=len(found)))
        order, done, some = np.argsort(-bounds, kind="stable"), 0, 16
        while done < len(order) and bounds[order[done]] >= best.least(item):
            part = order[done : done + some]
            part = part[bounds[part] >= best.least(item)]
            members = np.concatenate([by_group[(last[g - 1] if g else 0) : last[g]] for g in part])
            self.evaluate(item, np.sort(members), at, weights, best)
            done, some = done + some, some * 2

    def evaluate(self, item: int, docs: np.ndarray, at: np.ndarray, weights: np.ndarray, best: _Best) -> None:
        scores = np.zeros(len(docs), np.int64)
        for term, weight in zip(at, weights):
            held = self.owner[self.starts[term] : self.ends[term]]
            place = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            scores += np.where(held[place] == docs, weight * self.adds[self.starts[term] + place], 0)
        good = scores >= best.least(item)
        best.add(item, scores[good], self.ids.take(pa.array(docs[good])))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded postings, or of one document."""
    ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + BLOCK_POSTINGS, side="right")))
        yield batch.slice(start, end - start)
        start = end


def best_documents(index: DataFrame, queries: Queries) -> DataFrame:
    """``(item, id, score)``: the best k of each task for each item, by its place in the block."""
    kind = index.schema["id"].dataType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            best = best or _Best(queries, batch.schema.field("id").type)
            for part in _parts(batch):
                block = _Block(part, queries)
                for item in range(len(queries.terms)):
                    block.search(item, queries, best)
        for item, scores in enumerate(best.scores if best else []):
            if len(scores):
                columns = [pa.array(np.full(len(scores), item, np.int32)), best.ids[item], pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])

    return index.mapInArrow(searched, f"item int, id {kind}, score long")


def _item_blocks(items: DataFrame, key: str, text: str, block_terms: int) -> Iterator[pa.Table]:
    """Items in blocks of about ``block_terms`` terms; a block is what is fetched and sent at once."""
    rows = items.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0
    parts = max(1, math.ceil(total / block_terms))
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(parts))
    for part in range(parts):
        yield rows.where(place == part).orderBy("id", "text").toArrow()


def ranked_documents(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", k: int = 20, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``(item_key, rank, key, score)``: the ``k`` documents of highest score above 0 per item.

    With N documents that have a term, L terms in them, n in one of them, df documents with a
    term and tf occurrences in one: w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + 25 n N
    div L, and the score sums w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats
    included. Equal scores rank by ascending key, null keys last. Every row of ``docs`` and of
    ``items`` counts, so repeated rows rank side by side and a repeated item has its ranks again.
    Null and termless texts match nothing; an empty table gives an empty table.
    """
    out = None
    for held in _item_blocks(items, item_key, item_text, block_terms):
        counts = [Counter(w for words in cut_terms(t) for w in words) for t in utf8(held["text"].combine_chunks())]
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
        index = stored(index_documents(docs, key, text, vocabulary).where("n > 0"), "index")
        documents, tokens = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        # a term of the block's vocabulary each, so as bounded as that
        found = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
        df[found["t"].to_numpy()] = found["df"].to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        terms, weights = [], []
        for counted in counts:
            own = np.array(sorted(vocabulary[w] for w in counted), np.int64)
            times = dict((vocabulary[w], c) for w, c in counted.items())
            value = weight[own] * np.array([times[t] for t in own.tolist()], np.int64) if len(own) else own
            terms.append(own[value > 0])
            weights.append(value[value > 0])
        best = best_documents(index, Queries(terms, weights, documents, tokens, k))
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = docs.sparkSession.createDataFrame(
            pa.table({"item": pa.array(range(held.num_rows), pa.int32()), "name": held["id"]})
        )
        ranked = ranked.join(F.broadcast(named), "item").select(
            F.col("name").cast(items.schema[item_key].dataType).alias(item_key), "rank", F.col("id").alias(key), "score"
        )
        out = ranked if out is None else out.unionByName(ranked)
    return out
