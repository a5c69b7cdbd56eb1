"""Quality classifier: hashed word n-grams, FTRL-proximal logistic regression, sparse dot products."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordHashes, blocks, joined, mixed, sums
from granary.llm.labelled import labelled_texts

#: Words, and runs of signs as words of their own; case matters.
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_AGAIN = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class QualityModel:
    """Weights by hashed n-gram (a power of two of them) and the bias."""

    weights: np.ndarray
    bias: float


def _grams(hashes: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words and of all word pairs; a pair's place is at its first word.

    The last word of a text pairs with its end. The second of two equal words counts as the sign
    "again", so that repetition is seen whatever is repeated.
    """
    after = np.empty_like(hashes)
    after[:-1] = hashes[1:]
    ends = np.cumsum(lengths)[lengths > 0] - 1
    after[ends] = 0
    again = after == hashes
    first = np.where(again, _AGAIN, hashes)
    pairs = joined(first, np.where(again, _AGAIN, after))
    shift = np.uint64(64 - bits)
    return (mixed(hashes) >> shift).astype(np.int64), (mixed(pairs) >> shift).astype(np.int64)


def _sparse(text: str, cache: WordHashes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text: counts over the square root of its words."""
    hashes = cache.of(_TOKEN.findall(text))
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    words, pairs = _grams(hashes, np.array([len(hashes)]), bits)
    places, counts = np.unique(np.concatenate([words, pairs]), return_counts=True)
    return places.astype(np.int32), (counts / np.sqrt(len(hashes))).astype(np.float32)


def fit_ftrl(
    texts: list[str], labels: np.ndarray, bits: int = 20, epochs: int = 4, alpha: float = 0.3,
    beta: float = 1.0, l1: float = 0.02, l2: float = 0.02,
) -> QualityModel:
    """One pass after another of follow-the-regularised-leader updates, a row at a time.

    Without rows every score is 0.5. Memory: two tables of 2**bits doubles and the sparse rows.
    """
    cache = WordHashes()
    rows = [_sparse(t, cache, bits) for t in texts]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0

    def weights_at(at):
        shrunk = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, shrunk / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            w = weights_at(at)
            error = 1 / (1 + np.exp(-np.clip(w @ value + bias, -30, 30))) - labels[i]
            g = error * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            zb += error - (np.sqrt(nb + error**2) - np.sqrt(nb)) / alpha * bias
            nb += error**2
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    return QualityModel(weights_at(slice(None)).astype(np.float32), float(bias))


def fit_quality(
    docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality",
    key: str = "doc_id", text: str = "text", per_class: int = 2_000, max_chars: int = 16_000_000,
) -> QualityModel:
    """Fit on at most ``per_class`` labelled rows of each class and ``max_chars`` characters.

    Scores are for the share of classes in the sample; the bound is on training rows only.
    """
    texts, marks = labelled_texts(docs, labels, label, usable, per_class, max_chars, key, text)
    return fit_ftrl(texts, marks)


def quality_score(text: Column, model: QualityModel) -> Column:
    """Probability of label 1. Null and empty texts have no n-gram: they get the bias's score."""
    weights, bias = model.weights, model.bias
    bits = int(np.log2(len(weights)))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = WordHashes()
        for texts in batches:
            out = []
            cut = lambda t: _TOKEN.findall(t.as_py() or "")
            for held, lengths in blocks(texts, cut):
                hashes = np.concatenate([cache.of(words) for words in held])
                if len(hashes):
                    words, pairs = _grams(hashes, lengths, bits)
                    total = sums(weights[words].astype(np.float64) + weights[pairs], lengths)
                else:
                    total = np.zeros(len(lengths))
                out.append(total / np.sqrt(np.maximum(lengths, 1)) + bias)
            logit = np.concatenate(out) if out else np.zeros(0)
            yield pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))), pa.float64())

    return scored(text)
