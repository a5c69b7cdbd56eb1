"""Ward clustering of large tables through clustering features.

A clustering feature is the weight and the mean of points that were merged. Equal points are one
feature to begin with. While there are more than ``LIMIT`` features, they are dealt over blocks of
about that many by a hash of their content, and Ward merging brings each block down to ``KEPT``;
so a level takes a task per block and the next one has a quarter of the rows. The at most
``LIMIT`` features that remain are merged in full by the nearest-neighbour chain, and a table with
no more distinct points than that is clustered exactly.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.errors import ValidationError
from granary.session import settled

# The kernels travel to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT, KEPT = 2_000, 500
#: Distances that a task holds at once.
_SLAB = 500_000


def merges_of(centres: np.ndarray, weights: np.ndarray) -> list[tuple[float, int, int]]:
    """All Ward merges, cheapest first: the rise in squared error, and the smallest point of each side.

    A chain goes from a cluster to its nearest one until two are each other's nearest; those are
    merged. Costs only rise along merges, so sorting them gives the order of greedy merging.
    """
    centre, weight = np.ascontiguousarray(centres.T, dtype=float).copy(), weights.astype(float).copy()
    alive, name = np.ones(len(weight), bool), np.arange(len(weight))
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < len(weights) - 1:
        if 2 * (len(weights) - len(merges)) <= len(weight):  # merged points are left out
            place = np.cumsum(alive) - 1
            chain = [int(place[c]) for c in chain]
            centre, weight, name = np.ascontiguousarray(centre[:, alive]), weight[alive], name[alive]
            alive = np.ones(len(weight), bool)
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            top = chain[-1]
            gap = centre - centre[:, top, None]
            cost = weight * weight[top] / (weight + weight[top]) * (gap * gap).sum(axis=0)
            cost[~alive] = np.inf
            cost[top] = np.inf
            near = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
                near = chain[-2]
                break
            chain.append(near)
        chain.pop()
        chain.pop()
        low, high = min(top, near), max(top, near)
        merges.append((float(cost[near]), int(name[low]), int(name[high])))
        total = weight[low] + weight[high]
        centre[:, low] = (weight[low] * centre[:, low] + weight[high] * centre[:, high]) / total
        weight[low], alive[high] = total, False
    return sorted(merges, key=lambda m: m[0])


def cut(merges: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """The cluster of each of ``n`` points, numbered from 0 in order of their first points."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, a, b in merges[: max(0, n - k)]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def _joined(centres: np.ndarray, weights: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.bincount(labels, weights)
    sums = np.zeros((len(total), centres.shape[1]))
    np.add.at(sums, labels, centres * weights[:, None])
    return sums / total[:, None], total


def _reduced(block: pd.DataFrame) -> pd.DataFrame:
    block = block.iloc[np.lexsort(np.stack(block["vec"].to_numpy()).T)]
    centres, weights = np.stack(block["vec"].to_numpy()), block["weight"].to_numpy(float)
    labels = cut(merges_of(centres, weights), len(weights), KEPT)
    centres, weights = _joined(centres, weights, labels)
    return pd.DataFrame({"vec": list(centres), "weight": weights})


def _dense(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``width`` finite entries as a matrix, and which rows those are."""
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    entries = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    whole = sizes == width
    matrix = entries[np.repeat(whole, sizes)].reshape(-1, width)
    finite = np.isfinite(matrix).all(axis=1)
    known = whole.copy()
    known[whole] = finite
    return matrix[finite], known


def _nearest(vectors: np.ndarray, features: np.ndarray) -> np.ndarray:
    """For each vector the first of its nearest features, a slab of distances at a time."""
    out = np.empty(len(vectors), np.int64)
    step = max(1, _SLAB // len(features))
    for i in range(0, len(vectors), step):
        far = np.zeros((len(vectors[i : i + step]), len(features)))
        for x, f in zip(vectors[i : i + step].T, features.T):
            gap = x[:, None] - f
            gap *= gap
            far += gap
        out[i : i + step] = far.argmin(axis=1)
    return out


@dataclass(frozen=True)
class WardModel:
    """The merged features and how they are cut into ``k`` clusters."""

    features: np.ndarray
    weights: np.ndarray
    merges: list
    k: int

    hasSummary = False

    def with_k(self, k: int) -> WardModel:
        return replace(self, k=k)

    @property
    def labels(self) -> np.ndarray:
        return cut(self.merges, len(self.weights), self.k)

    def clusterCenters(self) -> list:  # noqa: N802 - the name Spark's models use
        return list(_joined(self.features, self.weights, self.labels)[0])

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: the cluster of the nearest feature, -1 for vectors with gaps."""
        features, labels = self.features, self.labels.astype(float)

        @F.arrow_udf("double")
        def nearest(values: pa.Array) -> pa.Array:
            vectors, known = _dense(values, features.shape[1])
            out = np.full(len(known), -1.0)
            out[known] = labels[_nearest(vectors, features)]
            return pa.array(out)

        return df.withColumn("prediction", nearest(vector_to_array("features")))


def fit_ward(df: DataFrame, k: int, limit: int = LIMIT) -> WardModel:
    """Fit on the vectors in ``features``; those that are null or not finite are left out."""
    if k < 1:
        raise ValidationError("k must be at least 1")
    vec = vector_to_array("features")
    rows = df.where("features is not null").select(vec.alias("vec")).where(F.forall("vec", lambda v: F.abs(v) < math.inf))
    rows = settled(rows.groupBy("vec").agg(F.count("*").cast("double").alias("weight")))
    while (n := rows.count()) > limit:
        block = F.pmod(F.xxhash64("vec"), F.lit(math.ceil(n / limit)))
        rows = settled(rows.groupBy(block.alias("block")).applyInPandas(_reduced, "vec array<double>, weight double"))
    held = rows.toPandas()
    if not len(held):
        raise ValidationError("No rows to cluster")
    held = held.iloc[np.lexsort(np.stack(held["vec"].to_numpy()).T)]
    centres, weights = np.stack(held["vec"].to_numpy()), held["weight"].to_numpy(float)
    return WardModel(centres, weights, merges_of(centres, weights), k)
