"""Nearest neighbours and density clustering over vectors, exact and in bounded tasks.

Points are filed under the nearest of about sqrt(n) pivots, and cells of near pivots are bundled to
about BLOCK points. A query visits a bundle only if the triangle inequality leaves room for a
neighbour in one of its cells, so its vector travels once to a bundle, not to each cell. Visits are
worked off in blocks: both the points and the visitors of a bundle are split by hash into pieces of
about BLOCK rows, so a bundle holding a third of the table becomes many tasks. A block never emits
its pairs, only what they add up to: the k best, a neighbour count, or one link per point.

Where the shared folder is a mounted one, the search for nearest neighbours moves no vector to a bundle:
each bundle's points are written once, and a task holds some queries and reads the bundles that they must visit,
so the disk it takes follows the points and not the pairs. Squared distances from a matrix product
sort out pairs that are too far by more than its rounding; the others get the same distance as elsewhere.
"""

from __future__ import annotations

import math
import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ValidationError
from granary.functions.kinds import col
from granary.operators import density, hashed
from granary.operators.components import components
from granary.session import local_frame, settled, shared_folder, shuffles_deleted

# The kernels travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 2_000
MAX_PIVOTS = 8_192
ROUNDING = 1e-9
_SLAB = 4_000_000
#: Queries of a task at most, and at least where there are cores left, in the search for nearest neighbours.
MANY_ASKED, FEW_ASKED = 20_000, 500
#: Bytes of points that a task writes.
WRITTEN_BYTES = 16 << 20


def vector_array(df: DataFrame, column: str):
    """A vector or array column as ``array<double>``."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return col(column).cast("array<double>")
    return vector_to_array(col(column))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``, in bounded slabs."""
    out = np.empty((len(a), len(b)))
    step = max(1, _SLAB // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def slices(batches, width: int):
    """Cut Arrow batches so that a slice's distances to all pivots stay small."""
    step = max(1, _SLAB // width)
    for pdf in batches:
        for i in range(0, len(pdf), step):
            yield pdf.iloc[i : i + step]


@dataclass(frozen=True)
class Cells:
    """Pivots with the number of points filed under each, their farthest distance, and its bundle."""

    pivots: np.ndarray
    counts: np.ndarray
    radii: np.ndarray
    bundle: np.ndarray

    @property
    def bundles(self) -> int:
        return int(self.bundle.max()) + 1

    @property
    def blocks(self) -> np.ndarray:
        held = np.bincount(self.bundle, self.counts, self.bundles).astype(int)
        return np.maximum(1, -(-held // BLOCK))

    def bundled(self, marked: np.ndarray) -> np.ndarray:
        """Marks of rows and cells as marks of rows and bundles."""
        out = np.zeros((len(marked), self.bundles), bool)
        for cell, bundle in enumerate(self.bundle):
            out[:, bundle] |= marked[:, cell]
        return out


def _bundled(pivots: np.ndarray, n: int) -> np.ndarray:
    """The bundle of each pivot: the nearest of evenly chosen ones, of which there is one for BLOCK points."""
    leaders = pivots[:: max(1, len(pivots) * BLOCK // max(1, n))]
    return distances(pivots, leaders).argmin(axis=1)


def _choose_pivots(points: DataFrame, n: int) -> np.ndarray:
    wanted = int(min(MAX_PIVOTS, max(1, math.sqrt(n))))
    rows = points.select("vec").orderBy(F.xxhash64(F.lit(17), "vec")).limit(wanted).collect()
    return np.unique(np.array([r["vec"] for r in rows], dtype=float), axis=0)


def _filed(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``pivot`` and ``off``: the nearest pivot and the distance to it."""

    def file(batches):
        for pdf in slices(batches, len(pivots)):
            d = distances(np.stack(pdf["vec"].to_numpy()), pivots)
            near = d.argmin(axis=1)
            yield pdf.assign(pivot=near.astype("int32"), off=d[np.arange(len(pdf)), near])

    schema = T.StructType(
        [
            *points.schema.fields,
            T.StructField("pivot", T.IntegerType()),
            T.StructField("off", T.DoubleType()),
        ]
    )
    return points.mapInPandas(file, schema)


def _cell_points(points: DataFrame) -> tuple[DataFrame, Cells]:
    """Points with a unique ``key`` and ``vec``, filed under ``cell``, their bundle, and split into blocks."""
    n = points.count()
    pivots = _choose_pivots(points, n)
    filed = _filed(points, pivots)
    counts, radii = np.zeros(len(pivots), dtype=int), np.zeros(len(pivots))
    for r in filed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("far")).collect():
        counts[r["pivot"]], radii[r["pivot"]] = r["n"], r["far"]
    cells = Cells(pivots, counts, radii, _bundled(pivots, n))
    table = [(i, int(b)) for i, b in enumerate(cells.bundle)]
    table = local_frame(points.sparkSession, table, "pivot int, cell int")
    filed = filed.join(F.broadcast(table), "pivot").drop("pivot")
    return _with_block(filed, cells.blocks, "block"), cells


def _sized(df: DataFrame, sizes: np.ndarray) -> DataFrame:
    """Add ``pieces``: how many blocks the row's bundle is split into. One row per bundle."""
    if sizes.max() == 1:
        return df.withColumn("pieces", F.lit(1))
    rows = [(i, int(n)) for i, n in enumerate(sizes)]
    table = local_frame(df.sparkSession, rows, "cell int, pieces int")
    return df.join(F.broadcast(table), "cell")


def _with_block(df: DataFrame, sizes: np.ndarray, output: str) -> DataFrame:
    """Put each row into one piece of its bundle, by a hash of its key."""
    piece = F.pmod(F.xxhash64(F.lit(29), "key"), F.col("pieces")).cast("int")
    return _sized(df, sizes).withColumn(output, piece).drop("pieces")


def _in_every_block(df: DataFrame, sizes: np.ndarray, output: str) -> DataFrame:
    """Copy each row into every piece of its bundle."""
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    return _sized(df, sizes).withColumn(output, F.explode(every)).drop("pieces")


def _visits(visitors: DataFrame, cells: Cells, choose: Callable, seen: Callable | None = None) -> DataFrame:
    """One row per visitor and bundle. ``choose(pdf, d)`` marks the cells each row must visit,
    ``seen(d)`` those whose bundles it has visited."""
    pivots = cells.pivots

    def plan(batches):
        for pdf in slices(batches, len(pivots)):
            vectors = np.stack(pdf["vec"].to_numpy())
            d = distances(vectors, pivots)
            marked = cells.bundled(choose(pdf, d))
            if seen is not None:
                marked &= ~cells.bundled(seen(d))
            row, bundle = np.nonzero(marked)
            step = max(1, _SLAB // max(1, vectors.shape[1]))
            for i in range(0, len(row), step):  # a vector is repeated for each visit
                visit = pdf[["key", "vec"]].iloc[row[i : i + step]]
                yield visit.assign(cell=bundle[i : i + step].astype("int32"))

    schema = T.StructType(
        [visitors.schema["key"], visitors.schema["vec"], T.StructField("cell", T.IntegerType())]
    )
    return visitors.mapInPandas(plan, schema)


def _meet(
    visits: DataFrame, points: DataFrame, cells: Cells, kernel: Callable, schema: str
) -> DataFrame:
    """Run ``kernel(visitors, points)`` on every block of visitors against every block of points."""
    found = np.zeros(cells.bundles, dtype=int)
    for r in visits.groupBy("cell").count().collect():
        found[r["cell"]] = r["count"]
    crowd = np.maximum(1, -(-found // BLOCK))
    guests = _in_every_block(_with_block(visits, crowd, "crowd"), cells.blocks, "block")
    hosts = _in_every_block(points, crowd, "crowd")
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        d = distances(np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy()))
        return kernel(left, right, d)

    keys = ["cell", "block", "crowd"]
    return guests.groupBy(*keys).cogroup(hosts.groupBy(*keys)).applyInPandas(run, schema)


# -- k nearest neighbours --------------------------------------------------


def _first(d: np.ndarray, labels: np.ndarray, take: int) -> np.ndarray:
    """The places of the ``take`` least distances of each row in order, ties by label."""
    if not np.isfinite(d).all():
        return np.lexsort((np.broadcast_to(labels, d.shape), d), axis=1)[:, :take]
    last = np.partition(d, take - 1, axis=1)[:, take - 1, None]
    row, place = np.nonzero(d <= last)
    order = np.lexsort((labels[place], d[row, place], row))
    row, place = row[order], place[order]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    return place[number < take].reshape(len(d), take)


def _vector_key(df: DataFrame) -> DataFrame:
    """A 128-bit key of the vector: equal vectors have equal neighbours."""
    parts = [F.hex(F.xxhash64(F.lit(seed), "vec")) for seed in (3, 5)]
    return df.withColumn("key", F.concat_ws("-", *parts))


@dataclass(frozen=True)
class _Piece:
    """Up to BLOCK points of a bundle in a file: vectors, then labels, then weights."""

    path: str
    at: int
    n: int
    kind: str

    def read(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.n * d * np.dtype(self.kind).itemsize
        with open(self.path, "rb") as file:
            file.seek(self.at)
            held = file.read(size + 16 * self.n)
        vectors = np.frombuffer(held, self.kind, self.n * d).reshape(self.n, d).astype(float)
        return vectors, np.frombuffer(held, float, self.n, size), np.frombuffer(held, np.int64, self.n, size + 8 * self.n)


def _written(train: DataFrame, folder: str) -> tuple[list[list[_Piece]], Cells]:
    """Write the points of each bundle to files in ``folder``; each bundle's pieces, and the cells.

    Vectors are written as single precision where that loses nothing. Counts and radii of the cells are
    those of the points as they were written.
    """
    train = train.select("vec", "label", "weight")
    n = train.count()
    pivots = _choose_pivots(train, n)
    bundle = _bundled(pivots, n)

    def bundles(batches):
        for pdf in batches:
            yield pdf.assign(cell=bundle[pdf["pivot"].to_numpy()].astype("int32"))

    def write(batches):
        path, at = f"{folder}/{uuid.uuid4().hex}", 0
        with open(path, "wb") as file:
            for pdf in batches:
                for cell, own in pdf.groupby("cell"):
                    for i in range(0, len(own), BLOCK):
                        part = own.iloc[i : i + BLOCK]
                        vectors = np.stack(part["vec"].to_numpy()).astype(float)
                        with np.errstate(over="ignore", invalid="ignore"):
                            short = vectors.astype("f4")
                        kept = short if (short == vectors).all() else vectors
                        held = kept.tobytes() + part["label"].to_numpy(float).tobytes()
                        held += part["weight"].to_numpy(np.int64).tobytes()
                        file.write(held)
                        used, back = np.unique(part["pivot"].to_numpy(), return_inverse=True)
                        far = np.full(len(used), -np.inf)
                        np.maximum.at(far, back, part["off"].to_numpy(float))  # NaN stays
                        yield pd.DataFrame(
                            {
                                "cell": [cell], "path": [path], "at": [at], "n": [len(part)], "kind": [kept.dtype.str],
                                "pivots": [used.tolist()], "counts": [np.bincount(back).tolist()], "far": [far.tobytes()],
                            }
                        )
                        at += len(held)

    filed = _filed(train, pivots)
    filed = filed.mapInPandas(bundles, T.StructType([*filed.schema.fields, T.StructField("cell", T.IntegerType())]))
    parts = max(1, math.ceil(n * 8 * (pivots.shape[1] + 4) / WRITTEN_BYTES))
    dealt = filed.repartitionByRange(parts, "cell", F.xxhash64("vec")).sortWithinPartitions("cell")
    schema = "cell int, path string, at long, n long, kind string, pivots array<long>, counts array<long>, far binary"
    counts, radii = np.zeros(len(pivots), int), np.zeros(len(pivots))
    pieces: list[list[_Piece]] = [[] for _ in range(int(bundle.max()) + 1)]
    for r in dealt.mapInPandas(write, schema).collect():
        pieces[r["cell"]].append(_Piece(r["path"], r["at"], r["n"], r["kind"]))
        counts[r["pivots"]] += r["counts"]
        radii[r["pivots"]] = np.maximum(radii[r["pivots"]], np.frombuffer(r["far"]))
    return pieces, Cells(pivots, counts, radii, bundle)


class _Best:
    """The ``k`` nearest training values of each of some query vectors, of those it was offered."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors, self.k = vectors, k
        self.squares = (vectors * vectors).sum(axis=1)
        shape = (len(vectors), k)
        self.distance, self.label = np.full(shape, np.inf), np.zeros(shape)
        self.weight, self.empty = np.zeros(shape, np.int64), np.ones(shape, bool)
        self.reach = np.full(len(vectors), np.inf)

    def offer(self, rows: np.ndarray, vectors: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Offer all points to the queries ``rows``."""
        row, place, distance = self._near(rows, vectors, label)
        if not len(row):
            return
        met, row = np.unique(row, return_inverse=True)
        own = rows[met]
        row = np.concatenate([np.repeat(np.arange(len(met)), self.k), row])
        values = [
            np.concatenate([old[own].ravel(), new])
            for old, new in (
                (self.distance, distance), (self.label, label[place]), (self.weight, weight[place]),
                (self.empty, np.zeros(len(place), bool)),
            )
        ]
        order = np.lexsort((values[1], values[0], values[3], row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k].reshape(len(met), self.k)
        self.distance[own], self.label[own], self.weight[own], self.empty[own] = (v[order] for v in values)
        last = self.distance[own, -1]
        self.reach[own] = np.where(self.empty[own, -1] | np.isnan(last), np.inf, last)

    def _near(self, rows: np.ndarray, vectors: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs of a query and a point, their places, that may be among the query's best, and their distances."""
        asked, d = self.vectors[rows], vectors.shape[1]
        squares = (vectors * vectors).sum(axis=1)
        near = asked @ vectors.T
        near *= -2
        near += self.squares[rows, None]
        near += squares
        if not np.isfinite(near).all():
            found = distances(asked, vectors)
            take = min(self.k, len(vectors))
            place = _first(found, label, take)
            return np.repeat(np.arange(len(rows)), take), place.ravel(), np.take_along_axis(found, place, 1).ravel()
        off = 8 * (d + 8) * np.finfo(float).eps * (self.squares[rows] + squares.max())
        with np.errstate(over="ignore"):
            limit = self.reach[rows] ** 2 * (1 + 1e-12)
        short = np.flatnonzero(np.isinf(limit))
        if len(short) and len(vectors) > self.k:
            limit[short] = np.partition(near[short], self.k - 1, axis=1)[:, self.k - 1] + off[short]
        row, place = np.nonzero(near <= (limit + off)[:, None])
        found, step = np.empty(len(row)), max(1, _SLAB // max(1, d))
        for i in range(0, len(row), step):
            gap = asked[row[i : i + step]] - vectors[place[i : i + step]]
            found[i : i + step] = np.sqrt((gap * gap).sum(axis=1))
        return row, place, found


def nearest(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(key, distance, label, weight)``: for each query vector its nearest training values.

    ``train`` has ``vec, label, weight, key`` and ``queries`` has distinct ``vec, key``.
    First each query looks into the bundles of the nearest cells that hold at least ``k`` points. Its k-th
    distance there bounds the true one, and only bundles with a cell within the bound are visited next.
    """
    spark = train.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    shared = urlparse(context.getCheckpointDir())
    if shared.scheme != "file":
        return _nearest_by_visits(train, queries, k)
    folder = f"{unquote(shared.path)}/points-{uuid.uuid4().hex}"
    os.makedirs(folder)
    with shuffles_deleted(spark):
        pieces, cells = _written(train, folder)
        asked = queries.count()
    pivots, counts, radii = cells.pivots, cells.counts, cells.radii

    def search(batches):
        for pdf in slices(batches, max(len(pivots), BLOCK)):
            best = _Best(np.stack(pdf["vec"].to_numpy()).astype(float), k)
            d = distances(best.vectors, pivots)
            seen = cells.bundled(_home(d, counts, k))
            least = np.full(seen.shape, np.inf)  # no point of a bundle is nearer
            for cell in np.flatnonzero(counts):
                low = d[:, cell] - radii[cell]
                own = least[:, cells.bundle[cell]]
                np.minimum(own, np.where(np.isnan(low), -np.inf, low), out=own)

            def visit(bundle, rows):
                for piece in pieces[bundle] if len(rows) else ():
                    best.offer(rows, *piece.read(pivots.shape[1]))

            for bundle in range(cells.bundles):
                visit(bundle, np.flatnonzero(seen[:, bundle]))
            for bundle in np.argsort(least.min(axis=0), kind="stable"):
                within = ~(least[:, bundle] > best.reach * (1 + ROUNDING) + ROUNDING)
                visit(bundle, np.flatnonzero(within & ~seen[:, bundle]))
            held = ~best.empty
            yield pd.DataFrame(
                {
                    "key": np.repeat(pdf["key"].to_numpy(), held.sum(axis=1)),
                    "distance": best.distance[held],
                    "label": best.label[held],
                    "weight": best.weight[held],
                }
            )

    cores = context.defaultParallelism
    tasks = max(1, math.ceil(asked / MANY_ASKED), min(math.ceil(asked / FEW_ASKED), 3 * cores))
    schema = T.StructType(
        [
            queries.schema["key"], T.StructField("distance", T.DoubleType()),
            T.StructField("label", T.DoubleType()), T.StructField("weight", T.LongType()),
        ]
    )
    return _closest(queries.select("key", "vec").repartition(tasks).mapInPandas(search, schema), k)


def _home(d: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Marks of the nearest cells that hold at least ``k`` points, by distances of rows to all pivots."""
    order = np.argsort(d, axis=1, kind="stable")
    before = np.cumsum(counts[order], axis=1) - counts[order]
    marked = np.zeros(d.shape, dtype=bool)
    np.put_along_axis(marked, order, before < k, axis=1)
    return marked & (counts > 0)


def _nearest_by_visits(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``nearest`` where tasks reach no shared files: vectors are shuffled to each bundle they must visit."""
    points, cells = _cell_points(settled(train))
    counts, radii = cells.counts, cells.radii

    def best(left, right, d):
        take = min(k, d.shape[1])
        order = _first(d, right["label"].to_numpy(), take)
        return pd.DataFrame(
            {
                "key": np.repeat(left["key"].to_numpy(), take),
                "distance": np.take_along_axis(d, order, axis=1).ravel(),
                "label": right["label"].to_numpy()[order].ravel(),
                "weight": right["weight"].to_numpy()[order].ravel(),
            }
        )

    schema = "key string, distance double, label double, weight long"
    first = _meet(_visits(queries, cells, lambda pdf, d: _home(d, counts, k)), points, cells, best, schema)
    near = settled(_closest(first, k))
    reach = near.groupBy("key").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("reach")
    )

    def beyond(pdf, d):
        limit = pdf["reach"].astype(float).fillna(np.inf).to_numpy()[:, None]
        return (d - radii <= limit * (1 + ROUNDING) + ROUNDING) & (counts > 0)

    second = _meet(
        _visits(queries.join(reach, "key", "left"), cells, beyond, lambda d: _home(d, counts, k)), points, cells, best, schema
    )
    return _closest(near.select(*first.columns).unionByName(second), k)


def _closest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy("distance", "label")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_approximately(train: DataFrame, queries: DataFrame, k: int, **options) -> DataFrame:
    """``nearest`` through hash tables (options as in ``fit_tables``), exact for queries that
    meet fewer than k training values there."""
    train, queries = settled(train), settled(queries)
    tables = hashed.fit_tables(train, **options)
    if tables is None:
        return local_frame(train.sparkSession, [], "key string, distance double, label double, weight long")
    found = settled(hashed.nearest_hashed(train, queries, k, tables))
    whole = found.groupBy("key").agg(F.count("*").alias("met")).where(F.col("met") >= k).select("key")
    short = settled(queries.join(whole, "key", "left_anti"))
    found = found.join(whole, "key", "left_semi")
    if short.isEmpty():
        return found
    return found.unionByName(nearest(train, short, k).select(*found.columns))


def knn_predict(
    train: DataFrame, test: DataFrame, k: int = 5, task: str = "classification",
    features: str = "features", label: str = "label", method: str = "exact", **options,
) -> DataFrame:
    """The test table with ``prediction``: the vote or mean of the k nearest training rows.

    ``method`` "hashed" looks for them by locality-sensitive hashing instead: much fewer distances
    where vectors have structure, at the price of neighbours missed. Its options are ``tables``,
    ``bits``, ``probes`` and ``seed``.

    Equal training rows are folded into one with a weight, equal test vectors are looked up
    once. Ties at the border go to the smaller label, as do tied votes.
    """
    if k < 1:
        raise ValidationError("k must be at least 1")
    if method not in ("exact", "hashed"):
        raise ValidationError("method is exact or hashed")
    folded = (
        train.select(vector_array(train, features).alias("vec"), col(label).cast("double").alias("label"))
        .where("label is not null")
        .groupBy("vec", "label")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    points = folded.withColumn(
        "key", F.concat_ws("-", F.hex(F.xxhash64("vec")), F.col("label").cast("string"))
    )
    asked = _vector_key(test.withColumn("vec", vector_array(test, features)))
    find = nearest if method == "exact" else nearest_approximately
    found = find(points, asked.select("vec", "key").dropDuplicates(["key"]), k, **options)
    running = Window.partitionBy("key").orderBy("distance", "label").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("weight").over(running), F.lit(0))
    used = found.withColumn("used", F.least(F.col("weight"), k - before)).where("used > 0")
    if task == "classification":
        votes = used.groupBy("key", "label").agg(F.sum("used").alias("votes"))
        choice = F.max_by("label", F.struct(F.col("votes"), -F.col("label")))
        answer = votes.groupBy("key").agg(choice.alias("prediction"))
    else:
        mean = F.sum(F.col("label") * F.col("used")) / F.sum("used")
        answer = used.groupBy("key").agg(mean.alias("prediction"))
    return asked.join(answer, "key").drop("key", "vec")


# -- density clustering ----------------------------------------------------


def dbscan(
    df: DataFrame, features: str, eps: float, min_samples: int = 5, id_column: str | None = None
) -> DataFrame:
    """The table with ``cluster`` and ``is_core``: density clusters, noise is -1.

    A point is core with at least ``min_samples`` points within ``eps``, itself included.
    Core points within ``eps`` of each other share a cluster; other points join the smallest
    cluster among their core neighbours. A cluster is named by its smallest core id, which
    must not be negative, or by an assigned number where there is no id column. Equal vectors
    are folded into one weighted point. Vectors of few dimensions go through a grid, others through
    pivots, with the same result; null and non-finite vectors are noise.
    """
    if eps <= 0:
        raise ValidationError("eps must be positive")
    rows = df.withColumn("vec", vector_array(df, features))
    weight = F.count(F.lit(1)).alias("weight")
    if id_column is None:
        folded = settled(rows.groupBy("vec").agg(weight))
        folded = folded.withColumn("key", F.monotonically_increasing_id())
    else:
        folded = rows.groupBy("vec").agg(F.min(col(id_column)).cast("long").alias("key"), weight)
    folded = settled(folded)
    size = folded.agg(
        F.max(F.size("vec")).alias("d"), F.max(F.array_max(F.transform("vec", F.abs))).alias("far")
    ).first()
    d = size["d"] or 1
    fits = 1 <= d <= density.MAX_DIMENSIONS and (size["far"] or 0) * math.sqrt(d) / eps < density.MAX_CELL
    find = density.grid_labels if fits else _density_labels
    labels = find(folded, d, eps, min_samples)
    return rows.join(labels.withColumnRenamed("vec", "of_vec"), F.col("vec").eqNullSafe(F.col("of_vec"))).drop("vec", "of_vec")


def _density_labels(folded: DataFrame, d: int, eps: float, min_samples: int) -> DataFrame:
    finite = (F.size("vec") == d) & F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < math.inf))
    points, cells = _cell_points(folded.where(finite))
    points = settled(points)
    radii, counts = cells.radii, cells.counts

    def in_reach(pdf, d):
        return (d - radii <= eps * (1 + ROUNDING)) & (counts > 0)

    def count_close(left, right, d):
        near = ((d <= eps) * right["weight"].to_numpy()).sum(axis=1)
        return pd.DataFrame({"key": left["key"].to_numpy(), "near": near.astype("int64")})

    near = _meet(_visits(points, cells, in_reach), points, cells, count_close, "key long, near long")
    dense = near.groupBy("key").agg((F.sum("near") >= min_samples).alias("is_core"))
    points = settled(points.join(dense, "key"))
    core = points.where("is_core")

    def link(left, right, d):
        close = d <= eps
        a, b = left["key"].to_numpy(), right["key"].to_numpy()
        worst = np.iinfo("int64").max
        root_b = np.minimum(b, np.where(close, a[:, None], worst).min(axis=0))
        while True:
            root_a = np.minimum(a, np.where(close, root_b, worst).min(axis=1))
            again = np.minimum(root_b, np.where(close, root_a[:, None], worst).min(axis=0))
            if (again == root_b).all():
                break
            root_b = again
        return pd.DataFrame({"a": np.r_[a, b], "b": np.r_[root_a, root_b]})

    links = _meet(_visits(core, cells, in_reach), core, cells, link, "a long, b long")
    roots = components(links)
    named = settled(
        core.join(roots, core["key"] == roots["node"], "left").select(
            *core.columns, F.coalesce("root", "key").alias("cluster")
        )
    )

    def smallest(left, right, d):
        worst = np.iinfo("int64").max
        best = np.where(d <= eps, right["cluster"].to_numpy(), worst).min(axis=1)
        hit = best < worst
        return pd.DataFrame({"key": left["key"].to_numpy()[hit], "cluster": best[hit]})

    border = points.where("not is_core")
    joined = _meet(
        _visits(border, cells, in_reach), named, cells, smallest, "key long, cluster long"
    )
    labels = named.select("key", "cluster", F.lit(True).alias("is_core")).unionByName(
        joined.groupBy("key").agg(F.min("cluster").alias("cluster"), F.lit(False).alias("is_core"))
    )
    return folded.select("vec", "key").join(labels, "key", "left").select(
        "vec",
        F.coalesce("cluster", F.lit(-1)).alias("cluster"),
        F.coalesce("is_core", F.lit(False)).alias("is_core"),
    )
