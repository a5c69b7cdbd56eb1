"""Token counts through a digest cache.

A text's count is stored under the digest of its normalised content and the digest of the
tokenizer's version. Known digests are joined; only distinct misses are encoded, and then appended.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import stored, utf8, work_path

#: The largest tokenizer file that is sent to the tasks.
MOST_BYTES = 64 << 20
#: Texts, or words, that are encoded at once.
BATCH = 2_000
#: Words whose counts a task remembers; all are dropped when there are more.
KNOWN_WORDS = 400_000


class TokenCounter:
    """Counts of one tokenizer file: .json for ``tokenizers``, .model for ``sentencepiece``.

    Nothing is added, cut or padded. ``by_word``: the tokenizer drops ASCII white space and never
    joins across it, so a text's count is the sum over its words, each encoded once a task.
    """

    def __init__(self, kind: str, data: bytes, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_word, self.known = by_word, {}
        if kind == ".json":
            from tokenizers import Tokenizer

            coder = Tokenizer.from_str(data.decode())
            coder.no_truncation()
            coder.no_padding()
            self.encode = lambda texts: [
                len(e.ids) for e in coder.encode_batch_fast(texts, add_special_tokens=False)
            ]
        elif kind == ".model":
            import sentencepiece

            coder = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.encode = lambda texts: [len(x) for x in coder.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"No library here reads {kind} files")

    def count(self, text: bytes) -> int:
        if not self.by_word:
            return self.encode([text.decode()])[0]
        words = text.split()
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            if len(known) > KNOWN_WORDS:
                known.clear()
                new = list(set(words))
            for i in range(0, len(new), BATCH):
                part = new[i : i + BATCH]
                known.update(zip(part, self.encode([w.decode() for w in part])))
        return sum(map(known.__getitem__, words))


def normalised(text: bytes, by_word: bool) -> bytes:
    """What texts of one digest share: all bytes or, by word, the words in order."""
    return b" ".join(text.split()) if by_word else text


def content_digest(text: Column, by_word: bool) -> Column:
    """SHA-256 of the normalised content; null is empty."""

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        made = [hashlib.sha256(normalised(t, by_word)).digest() for t in utf8(texts)]
        return pa.array(made, pa.binary())

    return digest(text)


def tokenizer_digest(path: str, by_word: bool) -> str:
    """Names the tokenizer file's content, its library's version and the way of normalising."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    said = f"{library} {version(library)} {by_word}".encode()
    return hashlib.sha256(said + Path(path).read_bytes()).hexdigest()[:32]


def _cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """``(digest, n_tokens)`` that the cache has for the tokenizer; no cache is an empty one."""
    kinds = "digest binary, n_tokens long, tokenizer string"
    try:
        held = spark.read.schema(kinds).parquet(cache)
        held.isEmpty()
    except AnalysisException:
        held = spark.createDataFrame([], kinds)
    return held.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str | None = None, key: str = "doc_id",
    text: str = "text", by_word: bool = False,
) -> DataFrame:
    """``(key, n_bytes, n_tokens)``, one row per row of ``docs``; null texts are empty and have 0.

    ``tokenizer`` is a file on the driver, sent to the tasks if it has no more than MOST_BYTES.
    ``cache`` is a Parquet folder that may not exist yet (default: a new one in the shared
    folder); this call appends the counts it had to make. Before texts are moved, each task drops
    those it has seen, so a text with many copies travels once a task. Null and repeated keys keep
    a row each.
    """
    spark = docs.sparkSession
    cache = cache or work_path(spark, "token-cache")
    data = Path(tokenizer).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"The tokenizer file has more than {MOST_BYTES} bytes")
    sent = spark.sparkContext.broadcast((Path(tokenizer).suffix, data, by_word))
    named = tokenizer_digest(tokenizer, by_word)

    def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = [d not in seen and not seen.add(d) for d in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(new, pa.bool_()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*sent.value)
        seen: set[bytes] = set()
        for batch in batches:
            digests = batch.column(0).to_pylist()
            made = {d: counter.count(t) for d, t in zip(digests, utf8(batch.column(1))) if d not in seen}
            seen.update(made)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(made), pa.binary()), pa.array(list(made.values()), pa.int64())],
                ["digest", "n_tokens"],
            )

    whole = F.coalesce(F.col(text), F.lit(""))
    digest = content_digest(whole, by_word).alias("digest")
    rows = stored(docs.select(F.col(key).alias("id"), F.octet_length(whole).cast("long").alias("n_bytes"), digest), "digests")
    missing = rows.select("digest").distinct().join(_cached(spark, cache, named), "digest", "left_anti")
    texts = docs.select(digest, whole.alias("text")).mapInArrow(first_seen, "digest binary, text string")
    # the same digest meets in one task, which encodes it once
    wanted = texts.repartition("digest").join(missing.hint("shuffle_hash"), "digest", "left_semi")
    made = wanted.mapInArrow(encode, "digest binary, n_tokens long")
    made.withColumn("tokenizer", F.lit(named)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = rows.select("digest").distinct().join(_cached(spark, cache, named), "digest")
    return rows.join(stored(counts, "counts"), "digest").select(F.col("id").alias(key), "n_bytes", "n_tokens")
