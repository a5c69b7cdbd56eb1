"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of a task's word cache; it is emptied when full, so memory stays bounded.
CACHE_WORDS = 150_000
#: Tokens that a task handles at once.
BLOCK_TOKENS = 200_000

_own_folders: dict[str, str] = {}


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, which only a local master may do, one temporary folder a session is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _own_folders:
            _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="granary-")
        folder = _own_folders[context.applicationId]
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: lineage is cut, it is
    computed once, and a lost executor costs no recomputation of what came before."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``. A null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def lowest(df: DataFrame, place: Column, order: list[str], limit: int, rows: int) -> DataFrame:
    """The ``limit`` rows of the lowest ``place``, a 64-bit hash, ties by ``order``.

    ``rows`` is the number of rows of ``df``. Only rows below the hash under which that many are sure
    to lie (ten deviations more) are sorted, so what tasks send doesn't grow with their number.
    """
    share = (limit + 10 * math.sqrt(limit) + 10) / max(1, rows)
    if share < 1:
        df = df.where(place < F.lit(int(share * 2.0**64) - 2**63))
    return df.orderBy(place, *order).limit(limit)


def lowered(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z in lower case."""
    return text.lower().split()


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """Each text as bytes, one at a time; null is empty."""
    for value in texts.cast(pa.large_binary()):
        yield value.as_py() or b""


class WordHashes(dict):
    """XXH64 of words, remembered while the cache has room."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its start and of its next word."""
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` words in a row; of the whole sequence where it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = words[: len(words) - width + 1]
    for i in range(1, width):
        out = joined(out, words[i : len(words) - width + 1 + i])
    return mixed(out)


def blocks(texts: Iterable, cut, limit: int = BLOCK_TOKENS) -> Iterator[tuple[list, np.ndarray]]:
    """Lists of cut texts with their lengths, together about ``limit`` tokens at most (or one text)."""
    held: list = []
    total = 0
    for text in texts:
        words = cut(text)
        if held and total + len(words) > limit:
            yield held, np.array([len(x) for x in held], np.int64)
            held, total = [], 0
        held.append(words)
        total += len(words)
    if held:
        yield held, np.array([len(x) for x in held], np.int64)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each piece of ``values``, whose lengths are given; 0 for an empty piece."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], spread: str, limit: int) -> DataFrame:
    """``rows`` left-joined with the one row that ``table`` has for each key of the columns ``on``.

    Column ``n`` of ``table`` says how many of ``rows`` hold the key. Keys of more than ``limit``
    rows are dealt out over several parts by the column ``spread``, and their row of the table is
    repeated for each part, so no task gets all rows of a hot key. Only a hash of such keys, at
    most count / limit of them, is broadcast; the join itself compares the keys.
    """
    place, parts = F.xxhash64(*on), F.ceil(F.col("n") / limit)
    hot = F.broadcast(
        table.where(F.col("n") > limit).groupBy(place.alias("place")).agg(F.max(parts).alias("parts"))
    )
    part = F.pmod(F.xxhash64(spread), F.coalesce("parts", F.lit(1)))
    left = rows.withColumn("place", place).join(hot, "place", "left").withColumn("part", part)
    last = F.coalesce("parts", F.lit(1)) - 1
    right = table.withColumn("place", place).join(hot, "place", "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return left.drop("place", "parts").join(right.drop("place", "parts"), [*on, "part"], "left").drop("part")
