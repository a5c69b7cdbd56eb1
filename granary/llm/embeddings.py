"""Embedding near-duplicates by product quantisation.

Vectors of length one are filed in coarse inverted lists under their nearest centroid; what is left
of a vector is cut into subspaces and each part coded by its nearest codeword. A vector asks every
list that can hold a partner: a partner lies within the radius that the cosine implies, so it can
be in another list only if the plane half way between the two centroids is no farther than that.
All such lists are asked, so no partner is lost, whatever directions the vectors take.
Coded members are compared by distances looked up per subspace; the error of each code is stored
with it and added to the radius, so no partner is lost to quantisation. What passes is decided by
the exact cosine in double precision. Centroids and codewords are fitted on a sample, every vector
is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import lowest, stored
from granary.llm.components import components

COSINE = 0.95
#: Vectors that the index is fitted on, at most.
SAMPLE = 16_384
MOST_LISTS = 16_384
SUBSPACES, WORDS = 8, 256
#: Members, and askers, of a list that one task compares; a longer list is cut into blocks.
BLOCK = 4_096
_STEP = 256


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    #: (subspaces, words, dimensions of a subspace)
    codewords: np.ndarray
    radius: float


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    squares = (centres * centres).sum(axis=1)
    for i in range(0, len(x), 2_048):
        out[i : i + 2_048] = (squares - 2 * x[i : i + 2_048] @ centres.T).argmin(axis=1)
    return out


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of k-means; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _padded(x: np.ndarray) -> np.ndarray:
    """Zeros added to the dimensions, to a multiple of the subspaces: distances stay."""
    extra = -x.shape[1] % SUBSPACES
    return np.pad(x, ((0, 0), (0, extra))) if extra else x


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component first, so nothing over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_index(sample: np.ndarray, rows: int, cosine: float) -> Index:
    """About sqrt(rows) lists, fitted on the sample."""
    units = _padded(_units(sample)).astype(np.float32)
    centroids = _means(units, max(1, min(MOST_LISTS, int(math.sqrt(rows)))), 8, 1)
    rest = (units - centroids[_nearest(units, centroids)]).reshape(len(units), SUBSPACES, -1)
    words = [_means(np.ascontiguousarray(rest[:, s]), WORDS, 6, s + 2) for s in range(SUBSPACES)]
    radius = math.sqrt(2 - 2 * cosine) + 1e-5
    return Index(centroids, np.stack(words), radius)


def _matrix(vectors: pa.Array) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def encoded(units: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """List, code and code error of each vector, and the lists it must ask."""
    x = _padded(units).astype(np.float32)
    own = _nearest(x, index.centroids)
    rest = (x - index.centroids[own]).reshape(len(x), SUBSPACES, -1)
    code = np.stack([_nearest(rest[:, s], index.codewords[s]) for s in range(SUBSPACES)], axis=1)
    lost = rest - index.codewords[np.arange(SUBSPACES), code]
    error = np.sqrt((lost * lost).sum(axis=(1, 2))) + 1e-5
    c = index.centroids.astype(np.float64)
    squares = (c * c).sum(axis=1)
    asks = []
    for i in range(0, len(x), _STEP):
        part, at = x[i : i + _STEP].astype(np.float64), own[i : i + _STEP]
        from_all = squares - 2 * part @ c.T
        apart = np.sqrt(np.maximum(squares[at][:, None] + squares - 2 * c[at] @ c.T, 1e-18))
        beyond = from_all - from_all[np.arange(len(part)), at][:, None]
        asks += [np.flatnonzero(row) for row in beyond <= 2 * index.radius * apart + 1e-6]
    return own, code.astype(np.uint8), error.astype(np.float32), asks


def linked(asking: np.ndarray, members: np.ndarray, code: np.ndarray, error: np.ndarray, lists: np.ndarray,
           asked: np.ndarray, index: Index, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asker, member) whose exact cosine reaches the threshold.

    ``lists`` has the list of each member, ``asked`` (askers by distinct lists, in order) who asks
    which. The distance of an asker q to the code of a member of list c is
    ``|q - c|^2 - 2 sum q.w + sum (2 c.w + |w|^2)`` over the subspaces, where the products q.w are
    looked up in a table per asker that serves all lists.
    """
    left, right = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    order = np.argsort(lists, kind="stable")
    lists, column = np.unique(lists[order], return_inverse=True)
    subspaces = np.arange(SUBSPACES)
    centroids = index.centroids[lists]
    parts = centroids.reshape(len(lists), SUBSPACES, -1)
    code, lengths = code[order].astype(np.intp), (index.codewords * index.codewords).sum(axis=2)
    turned = np.einsum("swd,lsd->lsw", index.codewords, parts)
    words = lengths[subspaces, code] + 2 * turned[column[:, None], subspaces, code]
    # single precision loses a few units in the last place of sums of up to about nine
    reach = (index.radius + error[order]) ** 2 + 1e-4 - words.sum(axis=1)
    askers = _padded(asking).astype(np.float32)
    for i in range(0, len(asking), _STEP):
        part, wanted = askers[i : i + _STEP], asked[i : i + _STEP]
        table = np.stack([index.codewords[s] @ p.T for s, p in enumerate(np.split(part, SUBSPACES, axis=1))])
        own = (part * part).sum(axis=1) - 2 * centroids @ part.T + (centroids * centroids).sum(axis=1)[:, None]
        own[~wanted.T] = np.inf
        at = np.flatnonzero(wanted.any(axis=0)[column])
        for k in range(0, len(at), _STEP):
            some = at[k : k + _STEP]
            # members by askers: a looked-up row is one copy of memory
            match = table[0].take(code[some, 0], axis=0)
            for s in range(1, SUBSPACES):
                match += table[s].take(code[some, s], axis=0)
            match *= 2
            match += reach[some, None]
            near = match >= own.take(column[some], axis=0)
            if not near.any():
                continue
            columns, rows = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            exact = asking[i + rows] @ members[order[some[columns]]].T >= cosine
            a, b = np.nonzero(exact & near[np.ix_(columns, rows)].T)
            left.append((i + rows[a]).astype(np.int32))
            right.append(order[some[columns[b]]].astype(np.int32))
    return np.concatenate(left), np.concatenate(right)


def _bundled(asks: list[np.ndarray], wide: int) -> pa.ListArray:
    """The lists each vector asks, in ascending order, cut into those of each bundle of ``wide`` lists."""
    flat, row = np.concatenate(asks), np.repeat(np.arange(len(asks)), [len(a) for a in asks])
    bundle = flat // wide
    new = np.flatnonzero(np.r_[True, (bundle[1:] != bundle[:-1]) | (row[1:] != row[:-1])])
    inner = pa.ListArray.from_arrays(pa.array(np.append(new, len(flat)), pa.int32()), pa.array(flat, pa.int64()))
    outer = np.searchsorted(row[new], np.arange(len(asks) + 1))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)


def _lowest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of n places reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _usable(vector: str) -> Column:
    """No null, no component null or not finite, and not all zero."""
    return F.expr(
        f"{vector} is not null and size({vector}) > 0 and exists({vector}, x -> x <> 0) and forall({vector}, "
        "x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )


def _compared(coded: DataFrame, index: Index, cosine: float, wide: int) -> DataFrame:
    """``(id, n, root)``: links that a block found for an id, and an id it is connected to.

    Lists are taken in bundles of ``wide`` lists, together about BLOCK members, and a vector travels
    once to each bundle it asks a list of, with the lists it asks there. Members and askers of a bundle are cut into
    blocks by hash, so a crowded list is spread over tasks.
    """
    spark = coded.sparkSession
    sent = spark.sparkContext.broadcast(index)
    members = coded.select(F.floor(F.col("list") / wide).alias("bundle"), "id", "n", "v", "list", "code", "error")
    asks = coded.select(F.explode("asks").alias("asks"), F.col("list").alias("home"), "id", "n", "v")
    asks = asks.withColumn("bundle", F.floor(F.element_at("asks", 1) / wide))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        count = df.groupBy("bundle").agg(F.count("*").alias("rows"))
        return count.select(F.col("bundle").alias("of"), F.ceil(F.col("rows") / BLOCK).cast("int").alias(name))

    # a row for each list at most, so the table of block counts has a bound
    shape = stored(blocks(members, "m").join(blocks(asks, "q"), "of"), "lists")
    shape = F.broadcast(shape)
    spread = F.xxhash64("id")

    def up_to(n: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)

    members = members.join(shape, F.col("bundle") == F.col("of")).select(
        "bundle", F.pmod(spread, "m").alias("mb"), F.explode(up_to("q")).alias("qb"),
        "list", "id", "n", "v", "code", "error", F.lit(None).cast("array<long>").alias("asks"),
        F.lit(None).cast("long").alias("home"),
    )
    asks = asks.join(shape, F.col("bundle") == F.col("of")).select(
        "bundle", F.explode(up_to("m")).alias("mb"), F.pmod(spread, "q").alias("qb"),
        F.lit(None).cast("long").alias("list"), "id", "n", "v", F.lit(None).cast("binary").alias("code"),
        F.lit(None).cast("float").alias("error"), "asks", "home",
    )

    def compare(group: pa.Table) -> pa.Table:
        index = sent.value
        side = group["list"].is_valid()
        # askers of one list ask much the same lists, so they come together
        of, by = group.filter(side), group.filter(group["list"].is_null()).sort_by("home")
        ids_of, ids_by = of["id"].to_numpy(), by["id"].to_numpy()
        a = b = np.zeros(0, np.int32)
        if len(of) and len(by):
            code = np.frombuffer(b"".join(of["code"].to_pylist()), np.uint8).reshape(len(of), -1)
            lists, error = of["list"].to_numpy(), of["error"].to_numpy()
            members, asking = _units(_matrix(of["v"])), _units(_matrix(by["v"]))
            present, asks = np.unique(lists), by["asks"].combine_chunks()
            owner = np.repeat(np.arange(len(by)), asks.value_lengths().to_numpy())
            place = np.searchsorted(present, asks := asks.flatten().to_numpy())
            held = present[np.minimum(place, len(present) - 1)] == asks
            asked = np.zeros((len(by), len(present)), bool)
            asked[owner[held], place[held]] = True
            a, b = linked(asking, members, code, error, lists, asked, index, cosine)
            other = ids_by[a] != ids_of[b]
            a, b = a[other], b[other]
        names, place = np.unique(np.concatenate([ids_by[a], ids_of[b]]), return_inverse=True)
        links = np.bincount(place[: len(a)], of["n"].to_numpy()[b], len(names)).astype(np.int64)
        root = names[_lowest(place[: len(a)], place[len(a) :], len(names))]
        return pa.table({"id": pa.array(names, pa.int64()), "n": links, "root": pa.array(root, pa.int64())})

    both = members.unionByName(asks)
    return both.groupBy("bundle", "mb", "qb").applyInArrow(compare, "id long, n long, root long")


def near_vectors(
    table: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE
) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row per row of ``table``.

    ``n_links`` counts the other vectors with a cosine of ``cosine`` or more, equal ones included;
    ``component_id`` is the smallest key that links reach. Vectors that are null, empty, zero, or
    hold null or non-finite components link with nothing, nor do vectors of different lengths or
    rows with a null key (their component is null, and they aren't kept). Keys are integers; rows
    that share a key are one node. Equal vectors are folded into one first.
    """
    marks = [F.xxhash64(vector).alias("h"), F.xxhash64(F.reverse(vector), F.lit(1)).alias("g")]
    usable = _usable(vector) & F.col(key).isNotNull()
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), usable.alias("usable"), *marks)
    folded = rows.where("usable").groupBy("h", "g", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    folded = stored(folded, "vectors")
    found = None
    for length, count in sorted(folded.groupBy(F.size("v")).count().collect()):
        own = folded.where(F.size("v") == length)
        taken = lowest(own, F.xxhash64("h"), ["h", "g"], sample, count).select("v").toArrow()
        index = fit_index(_matrix(taken["v"]), count, cosine)
        wide = max(1, BLOCK * len(index.centroids) // count)

        def encode(batches: Iterator[pa.RecordBatch], index=index, wide=wide) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists, code, error, asks = encoded(_units(_matrix(batch.column(2))), index)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns, pa.array(lists, pa.int64()), pa.array([c.tobytes() for c in code], pa.binary()),
                        pa.array(error, pa.float32()), _bundled(asks, wide),
                    ],
                    ["id", "n", "v", "list", "code", "error", "asks"],
                )

        kind = dict(own.dtypes)["v"]
        coded = own.select("id", "n", "v").mapInArrow(
            encode, f"id long, n long, v {kind}, list long, code binary, error float, asks array<array<long>>"
        )
        part = _compared(stored(coded, "coded"), index, cosine, wide)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = table.sparkSession.createDataFrame([], "id long, n long, root long")
    found = stored(found, "found")
    links = found.groupBy("id").agg(F.sum("n").alias("links")).withColumnRenamed("id", "of")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = folded.select("h", "g", "id", "n").join(links, F.col("id") == F.col("of"), "left")
    named = named.join(roots, F.col("id") == F.col("node"), "left").select(
        F.col("h").alias("h2"), F.col("g").alias("g2"), F.coalesce("root", "id").alias("root"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
    )
    rows = rows.select("id", "usable", "h", "g")
    joined = rows.join(
        stored(named, "named"), (F.col("h") == F.col("h2")) & (F.col("g") == F.col("g2")) & F.col("usable"), "left"
    )
    return joined.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("root", "id"), F.lit(False)).alias("kept"),
    )
