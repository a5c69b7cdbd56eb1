"""Approximate nearest neighbours by locality-sensitive hashing.

A table hashes a vector to one bit per random direction: the side of a cut laid through a random
point of the training data, so cuts are dense where the points are. Near vectors agree on most
bits. A query looks into its own bucket of each table and into those that differ in the bits whose
cuts it is nearest to (multi-probe). Buckets and their visitors are split into blocks, so one that
holds a third of the table is many tasks; a block emits the k best of each visitor, never its
pairs. Queries that meet fewer than k points are answered by the exact search.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.errors import ValidationError
from granary.session import looked_up, settled

# The kernels travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points of a bucket, and visitors of one, that a task compares at once.
BLOCK = 2_000
#: Points that a bucket should hold on average where the number of bits is not given.
BUCKET = 64
#: Bits next to their cuts that multi-probe may flip together.
FLIPPED = 8


@dataclass(frozen=True)
class HashTables:
    """Directions and cuts of each table, and how many buckets a query visits in one."""

    directions: np.ndarray  # tables x dimensions x bits
    cuts: np.ndarray  # tables x bits
    probes: int

    @property
    def bits(self) -> int:
        return self.cuts.shape[1]

    def margins(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return vectors @ self.directions[table] - self.cuts[table]

    def bucket(self, margins: np.ndarray, table: int) -> np.ndarray:
        codes = (margins > 0) @ (1 << np.arange(self.bits, dtype=np.int64))
        return codes + (table << self.bits)

    def visited(self, margins: np.ndarray, table: int) -> np.ndarray:
        """The buckets of each row in order of how far the row is from them; one row per query."""
        flipped = min(FLIPPED, self.bits)
        nearest = np.argsort(np.abs(margins), axis=1)[:, :flipped]
        cost = np.take_along_axis(margins, nearest, axis=1) ** 2
        subsets = (np.arange(1 << flipped)[:, None] >> np.arange(flipped)) & 1
        take = np.argsort(cost @ subsets.T, axis=1, kind="stable")[:, : self.probes]
        masks = np.zeros(take.shape, np.int64)
        for j in range(flipped):
            masks |= subsets[take, j] * (np.int64(1) << nearest[:, j : j + 1])
        return self.bucket(margins, table)[:, None] ^ masks


def fit_tables(train: DataFrame, tables: int = 8, bits: int | None = None, probes: int = 16, seed: int = 17) -> HashTables | None:
    """Hash tables for the vectors in ``vec``; cuts lie at a sample of ``tables * bits`` of them.

    The sample is drawn by a hash of the content. ``probes`` above the number of buckets that
    flips of the nearest ``FLIPPED`` bits reach makes no difference. None without vectors.
    """
    if tables < 1 or probes < 1 or (bits is not None and not 1 <= bits <= 40):
        raise ValidationError("tables and probes must be at least 1, bits between 1 and 40")
    n = train.count()
    bits = bits or min(40, max(1, math.ceil(math.log2(max(2, n) / BUCKET))))
    rows = train.select("vec").orderBy(F.xxhash64(F.lit(seed), "vec")).limit(tables * bits).collect()
    if not rows:
        return None
    points = np.array([r["vec"] for r in rows], float)
    rng = np.random.default_rng(seed)
    points = points[rng.permutation(np.arange(tables * bits) % len(points))].reshape(tables, bits, -1)
    directions = rng.normal(size=(tables, points.shape[2], bits))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    cuts = np.einsum("tbd,tdb->tb", points, directions)
    return HashTables(directions, cuts, probes)


def _pieces(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _piece(key: str, n: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(29), key), _pieces(n)).cast("int")


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), _pieces(n) - 1))


def _schema(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("bucket", T.LongType())])


def _filed(points: DataFrame, tables: HashTables, all_probes: bool) -> DataFrame:
    """A row per table, or per table and visited bucket, with ``bucket``."""

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 4_000):
                pdf = whole.iloc[start : start + 4_000]
                vectors = np.stack(pdf["vec"].to_numpy())
                for table in range(len(tables.cuts)):
                    margins = tables.margins(vectors, table)
                    found = tables.visited(margins, table) if all_probes else tables.bucket(margins, table)[:, None]
                    rows = np.repeat(np.arange(len(pdf)), found.shape[1])
                    yield pdf.iloc[rows].assign(bucket=found.ravel())

    return points.mapInPandas(file, _schema(points))


def met_buckets(train: DataFrame, queries: DataFrame, tables: HashTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Filed points, visits, and ``(bucket, n, guests)`` for the buckets that have both."""
    hosts, guests = settled(_filed(train, tables, False)), settled(_filed(queries, tables, True))
    sizes = hosts.groupBy("bucket").agg(F.count("*").alias("n")).join(
        guests.groupBy("bucket").agg(F.count("*").alias("guests")), "bucket"
    )
    return hosts, guests, settled(sizes)


def compared_pairs(sizes: DataFrame) -> int:
    """How many distances a search over these buckets takes."""
    return sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("guests")), F.lit(0))).first()[0]


def _best_in_block(k: int):
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["key", "tkey", "distance", "label", "weight"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        asked, held = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        take, parts = min(k, len(held)), []
        step = max(1, 4_000_000 // held.size)
        for i in range(0, len(asked), step):
            gap = asked[i : i + step, None, :] - held[None]
            d = np.sqrt((gap * gap).sum(axis=2))
            order = np.lexsort((np.broadcast_to(right["label"].to_numpy(), d.shape), d), axis=1)[:, :take]
            columns = [np.repeat(left["key"].to_numpy()[i : i + step], take), right["tkey"].to_numpy()[order].ravel()]
            columns += [np.take_along_axis(d, order, axis=1).ravel()]
            columns += [right[c].to_numpy()[order].ravel() for c in ("label", "weight")]
            parts.append(pd.DataFrame(dict(zip(names, columns))))
        return pd.concat(parts)

    return best


def nearest_hashed(train: DataFrame, queries: DataFrame, k: int, tables: HashTables) -> DataFrame:
    """``(key, distance, label, weight)``: the k nearest of the training values that each query meets.

    ``train`` has ``vec, label, weight, key`` and ``queries`` has distinct ``vec, key``. A query
    that meets fewer than k training values has no complete answer here.
    """
    points = train.select("vec", "label", "weight", F.col("key").alias("tkey"))
    hosts, guests, sizes = met_buckets(points, queries.select("vec", "key"), tables)
    hosts = looked_up(hosts, sizes, ["bucket"], "tkey", 4 * BLOCK).where("guests is not null")
    hosts = hosts.withColumn("block", _piece("tkey", "n")).withColumn("crowd", _every("guests"))
    asked = sizes.select("bucket", F.col("n").alias("held"), F.col("guests").alias("n"))
    guests = looked_up(guests, asked, ["bucket"], "key", 4 * BLOCK).where("held is not null")
    guests = guests.withColumn("crowd", _piece("key", "n")).withColumn("block", _every("held"))
    places = ["bucket", "block", "crowd"]
    left = guests.select("key", "vec", *places).groupBy(*places)
    right = hosts.select("tkey", "vec", "label", "weight", *places).groupBy(*places)
    kinds = ", ".join(f"{c} {dict(train.dtypes)[c]}" for c in ("label", "weight"))
    found = left.cogroup(right).applyInPandas(
        _best_in_block(k), f"key {dict(queries.dtypes)['key']}, tkey {dict(train.dtypes)['key']}, distance double, {kinds}"
    )
    # a point met in several tables counts once
    once = found.groupBy("key", "tkey", "label", "weight").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("key").orderBy("distance", "label")
    once = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return once.select("key", "distance", "label", "weight")
