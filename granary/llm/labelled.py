"""A bounded, repeatable sample of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored

#: A training text of more characters comes after all shorter ones of its class.
LONG_CHARS = 100_000


def within(sizes: np.ndarray, labels: np.ndarray, max_chars: int) -> np.ndarray:
    """Places of the rows to train on; rows are in the order of their class.

    Classes take turns, so they have equally many rows until one has no more. Rows up to
    ``LONG_CHARS`` are taken until one doesn't fit; a longer one that exceeds what is left, or the
    half of its class, is passed over.
    """
    turn = np.empty(len(labels), np.int64)
    for value in (0, 1):
        turn[labels == value] = np.arange((labels == value).sum())
    taken, used, full = [], [0, 0], False
    for i in np.lexsort((labels, turn)):
        size, label = int(sizes[i]), int(labels[i])
        fits = sum(used) + size <= max_chars
        if size > LONG_CHARS:
            fits = fits and used[label] + size <= max_chars // 2
        else:
            full = full or not fits
            fits = not full
        if fits:
            taken.append(i)
            used[label] += size
    return np.array(taken, np.int64)


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int,
    max_chars: int, key: str = "doc_id", text: str = "text",
) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels: at most ``per_class`` rows a class, ``max_chars`` characters in all.

    ``usable`` filters the rows of ``labels``. Rows are picked from the labelled rows that ``docs``
    has, in hash order of their key, long texts last (see ``within``), so the sample is random,
    repeatable and independent of partitioning. Null keys and labels are left out, of several
    labels for a key the largest counts, null texts count as empty, and rows of the same key and
    text are one. The picked rows are at most 2 * per_class, which is the bound of the broadcast.
    """
    known = (
        labels.where(usable)
        .select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("label"))
        .where("label_key is not null and label in (0, 1)")
        .groupBy("label_key").agg(F.max("label").alias("label"))
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_key"), F.xxhash64(whole).alias("mark"), F.length(whole).alias("size"))
    found = rows.where("doc_key is not null").distinct().join(known, F.col("doc_key") == F.col("label_key"))
    found = found.select(
        "doc_key", "mark", "size", "label", F.xxhash64(F.col("doc_key").cast("string")).alias("place")
    )
    found = stored(found, "labelled")
    order = [F.col("size") > LONG_CHARS, "place", "doc_key", "mark"]
    chosen = [found.where(F.col("label") == value).orderBy(*order).limit(per_class).toArrow() for value in (0, 1)]
    picked = pa.concat_tables(chosen)
    at = within(picked["size"].to_numpy(), picked["label"].to_numpy(), max_chars)
    if not len(at):
        return [], np.zeros(0, np.int64)
    picked = picked.take(pa.array(at)).select(["doc_key", "mark", "label"])
    picked = picked.append_column("turn", pa.array(np.arange(len(at))))
    asked = docs.sparkSession.createDataFrame(picked).select(
        F.col("doc_key").alias("asked"), F.col("mark").alias("asked_mark"), "label", "turn"
    )
    texts = docs.select(F.col(key).alias("doc_key"), whole.alias("sample_text")).join(
        F.broadcast(asked),
        (F.col("doc_key") == F.col("asked")) & (F.xxhash64("sample_text") == F.col("asked_mark")),
    )
    texts = texts.select("turn", "label", "sample_text").dropDuplicates(["turn"])
    sample: pa.Table = texts.orderBy("turn").toArrow()
    return sample["sample_text"].to_pylist(), sample["label"].to_numpy().astype(np.int64)
