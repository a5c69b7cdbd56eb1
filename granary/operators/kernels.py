"""Support vector machines with a Gaussian kernel, through random Fourier features.

The kernel exp(-gamma |x - y|^2) is the expected product of cosines along random directions, so a
linear machine on a few hundred such cosines stands in for the kernel one, and its training grows
with the rows instead of with their square. Classification is a linear SVC on the features.
Regression minimises the squared distance to a tube of half width ``epsilon`` around the target:
each round fits a ridge to the nearest points of the tubes, which lowers that loss every time.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.errors import ValidationError
from granary.session import reused, spread

# The map travels to the executors with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 256
ROUNDS, CHANGE = 20, 1e-4
#: The column that the machines read; it isn't in their results.
_MAPPED = "__mapped"


@dataclass(frozen=True)
class FourierMap:
    """Seeded directions and phases of the cosines."""

    directions: np.ndarray
    phases: np.ndarray

    @classmethod
    def drawn(cls, dimensions: int, gamma: float, features: int, seed: int) -> FourierMap:
        rng = np.random.default_rng(seed)
        directions = rng.normal(0, math.sqrt(2 * gamma), (dimensions, features))
        return cls(directions, rng.uniform(0, 2 * math.pi, features))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return math.sqrt(2 / len(self.phases)) * np.cos(vectors @ self.directions + self.phases)

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        dimensions = len(self.directions)

        @F.arrow_udf("array<double>")
        def mapped(values: pa.Array) -> pa.Array:
            known = np.nan_to_num(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
            flat = self.of(known)
            ends = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))

        return df.withColumn(_MAPPED, array_to_vector(mapped(vector_to_array(column))))


@dataclass
class KernelMachine:
    """A linear model on the mapped features. ``transform`` takes the same columns as in training."""

    map: FourierMap
    model: Any
    centre: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(self.map.transform(df)).drop(_MAPPED)
        return scored.withColumn("prediction", F.col("prediction") + self.centre) if self.centre else scored


def spread_gamma(train: DataFrame, column: str = "features") -> float:
    """1 / (dimensions * variance of all entries), the usual width for scaled inputs."""
    s = train.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(column)).alias("s")).first()["s"]
    mean, n = s["mean"].toArray(), s["count"]
    within = s["variance"].toArray() * (n - 1) / max(n, 1)
    total = float(np.mean(within) + np.var(mean))
    return 1.0 / (len(mean) * total) if total > 0 else 1.0


def fit_kernel(
    train: DataFrame, task: str, C: float = 1.0, gamma: float | None = None, epsilon: float = 0.1,  # noqa: N803
    features: int = FEATURES, rounds: int = ROUNDS, seed: int = 42,
) -> KernelMachine:
    """Fit on ``(features, label)``. ``epsilon`` is in units of the label; equal settings and rows
    give an equal model. Missing entries of a vector count as 0."""
    if C <= 0 or epsilon < 0 or features < 1 or (gamma is not None and gamma <= 0):
        raise ValidationError("C and gamma must be positive, epsilon not negative, features at least 1")
    known = train.where("label is not null and features is not null")
    first = known.select("features").first()
    if first is None:
        raise ValidationError("No rows to fit a kernel machine on")
    chosen = FourierMap.drawn(len(first[0]), gamma or spread_gamma(known), features, seed)
    n = known.count()
    # a mapped row takes 8 bytes a feature, so rows count for as many of the usual width
    dealt = spread(known.select("features", "label"), n * math.ceil(features / FEATURES))
    mapped = chosen.transform(dealt).select(_MAPPED, "label")
    with reused(mapped) as rows:
        if task == "classification":
            machine = LinearSVC(featuresCol=_MAPPED, regParam=1.0 / (C * n), maxIter=50, tol=1e-4, standardization=False)
            classes = int(rows.agg(F.max("label")).first()[0]) + 1
            if classes > 2:
                machine = OneVsRest(classifier=machine, featuresCol=_MAPPED)
            return KernelMachine(chosen, machine.fit(rows))
        return _fitted_tube(chosen, rows, n, C, epsilon, rounds)


def _fitted_tube(chosen: FourierMap, rows: DataFrame, n: int, c: float, epsilon: float, rounds: int) -> KernelMachine:
    centre, spread = rows.agg(F.avg("label"), F.stddev_pop("label")).first()
    # Spark divides the penalty by the deviation of what it fits, which is the tube's nearest point
    ridge = LinearRegression(
        featuresCol=_MAPPED, labelCol="aim", predictionCol="prediction", elasticNetParam=0.0,
        standardization=False, solver="normal", regParam=(spread or 1.0) / (c * n),
    )
    label = F.col("label") - centre
    aimed, before, model = rows.withColumn("aim", label), math.inf, None
    for _ in range(rounds):
        model = ridge.fit(aimed.select(_MAPPED, "aim"))
        found = model.transform(rows)
        aim = F.greatest(label - epsilon, F.least(label + epsilon, F.col("prediction")))
        loss = found.agg(F.sum((F.col("prediction") - aim) ** 2)).first()[0]
        if loss is None or loss > before * (1 - CHANGE) or loss <= 1e-9 * n:
            break
        aimed, before = found.withColumn("aim", aim).select(_MAPPED, "label", "aim"), loss
    return KernelMachine(chosen, model, centre)
