"""Language-model scoring with a log-frequency Bloom filter.

N-gram counts are quantised on a log scale, and an n-gram of level q is entered under its levels
1 to q. A count is read back by probing level after level until one is missing; probabilities
(Witten-Bell, interpolated over the orders) come from such reads. Besides counts the filter holds,
in the same way, how many different words follow a history.

The filter is cut into shards by hash, as many as the corpus needs, so its size follows the
number of n-grams. In a mounted shared folder it is written as one file that tasks map into memory,
whatever its size: the workers of a machine share its pages, and a block of texts goes through them in
the order of the shards. Where the shared folder is no mounted one, tasks get the filter as a broadcast
of at most BROADCAST_BYTES; beyond, each text's distinct n-grams are taken to the shards instead, with
the same answers, which moves many times the input. Word counts for the exact base score are exact: the
most frequent words are sent, the rest joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import CACHE_WORDS, WordHashes, blocks, joined, lowered, mixed, utf8, work_path
from granary.llm.common import stored as written
from granary.llm.mixing import word_count
from granary.session import shuffles_deleted

#: The token at the end of each text, and the history before its first word; no word has a space.
END, START = b" end", b" start"
#: Probes of a level, and bits for each entry: about eight false answers in a thousand.
PROBES, BITS = 7, 10.0
#: N-grams, repeats included, that one shard is made from.
SHARD_TOKENS = 3_000_000
#: Without a mounted shared folder, a filter up to this size is broadcast; every worker holds a copy.
BROADCAST_BYTES = 160 << 20
#: Words, at most, whose exact counts every task holds; the rest are joined.
HEAD_WORDS = 1_000_000
#: N-grams that a task counts before it passes partial counts on.
COUNT_TOKENS = 1_800_000
#: Keys that are entered into a filter at once.
BUILT_KEYS = 100_000
#: Keys that are looked up at once, and bytes of texts (or one text) that are scored at once.
PROBED_KEYS, SCORED_BYTES = 200_000, 2_000_000
#: Keys found missing are put aside when fewer than this share is left, and after a level's last probe.
FEW_LEFT = 0.8
_BASE = 1.15


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder; what was shuffled to make it is deleted at once."""
    with shuffles_deleted(df.sparkSession):
        return written(df, label)


def _levels() -> np.ndarray:
    """Least count of each level: 1, 2, 3, ... and then 15 % steps."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * _BASE)))
    return np.array(out, np.int64)


LEVELS = _levels()
#: The count that a level stands for.
MIDDLE = np.concatenate([[0.0], np.sqrt(LEVELS.astype(np.float64) * np.append(LEVELS[1:] - 1, LEVELS[-1]))])


_START = np.uint64(xxhash.xxh64_intdigest(START, 1))
#: Told apart under the same hash: a history's followers, and its count. They leave the upper 24
#: bits, by which keys are sharded.
_FOLLOWERS, _TOTAL = np.uint64(0xD6E8FEB866), np.uint64(0xA0761D6478)


def grams(words: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, by length: 1 to ``order``.

    ``words`` are the texts' tokens with their ends; a history never reaches over a text's start,
    where it is filled with the start sign.
    """
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = [mixed(words)]
    for n in range(1, order):
        before = np.empty_like(words)
        before[n:] = words[:-n]
        before[place < n] = _START
        out.append(joined(before, out[-1]))
    return out


def histories(words: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the histories before each token, by length: 1 to ``order`` - 1."""
    shifted = np.empty_like(words)
    shifted[1:] = words[:-1]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    shifted[starts] = _START
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = [mixed(shifted)]
    for n in range(2, order):
        before = np.empty_like(words)
        before[n:] = words[:-n]
        before[place < n] = _START
        out.append(joined(before, out[-1]))
    return out


def _first_step(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's probes of a level lie at the first, and on by steps, modulo the number of bits."""
    first = mixed(keys ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return first, (first >> np.uint64(32)) | np.uint64(1)


def built(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A shard that holds each key under the levels 1 to that of its count."""
    levels = np.searchsorted(LEVELS, counts, side="right").astype(np.uint16)
    flags = np.zeros(int(levels.sum(dtype=np.int64) * BITS / 8) * 8 + 64, bool)
    size, level = np.uint64(len(flags)), 1
    while len(keys):
        for begin in range(0, len(keys), BUILT_KEYS):
            place, step = _first_step(keys[begin : begin + BUILT_KEYS], level)
            for _ in range(PROBES):
                flags[(place % size).view(np.int64)] = True
                place += step
        level += 1
        more = levels >= level
        keys, levels = keys[more], levels[more]
    return np.packbits(flags, bitorder="little").tobytes()


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _shard_order(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards of the keys in ascending order, and the keys' places in that order."""
    shard = shard_of(keys, shards)
    shard = shard.astype(np.uint16) if shards <= 1 << 16 else shard  # short numbers are sorted by digits
    order = np.argsort(shard, kind="stable")
    return shard[order], order


@dataclass(frozen=True)
class Filter:
    """Bytes that hold all shards, and where each shard begins and how many bits it has."""

    bits: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(bits: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Filter:
        """From bytes that hold the shards, which are not copied, and place and length of each."""
        return Filter(bits, begin, size.astype(np.uint64) * np.uint64(8))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts read back: repeated membership probes, level by level, until one is missing."""
        parts = [self._levels(keys[k : k + PROBED_KEYS]) for k in range(0, len(keys), PROBED_KEYS)]
        return MIDDLE[np.concatenate(parts)] if parts else np.zeros(0)

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        shard, at = _shard_order(keys, len(self.size))
        keys, begin, size = keys[at], self.begin[shard], self.size[shard]
        found = np.zeros(len(keys), np.int64)
        level = 1
        while len(at) and level <= len(LEVELS):
            place, step = _first_step(keys, level)
            there = np.ones(len(at), bool)
            for probe in range(1, PROBES + 1):
                bit = place % size
                byte = self.bits.take(begin + (bit >> np.uint64(3)).view(np.int64))
                there &= (byte >> (bit & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)
                live = np.count_nonzero(there)
                if live < len(at) * (FEW_LEFT if probe < PROBES else 1):
                    left = np.flatnonzero(there)
                    at, keys, begin, size = (values.take(left) for values in (at, keys, begin, size))
                    place, step, there = place.take(left), step.take(left), np.ones(live, bool)
                place += step
            found[at] = level
            level += 1
        return found


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)]


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary() if n in ("keys", "past", "a", "b") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _by_shard(keys: np.ndarray, shards: int, *values: np.ndarray) -> Iterator[tuple]:
    shard, order = _shard_order(keys, shards)
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        own = order[bounds[p] : bounds[p + 1]]
        yield (int(p), keys[own], *(v[own] for v in values))


def counted(words: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, ...]]:
    """By length, 1 to ``order``: keys of the distinct n-grams, keys of their histories, and counts.

    An n-gram is known by the number of its first word, 0 for the start sign, and that of the
    shorter n-gram after it, so keys are made for distinct n-grams only. Those of one history lie side by
    side; n-grams of one word have no history and get their own key.
    """
    distinct, back, counts = np.unique(words, return_inverse=True, return_counts=True)
    word, back = np.concatenate([[_START], distinct]), back.astype(np.int32)
    own = back + np.int32(1)
    keys = mixed(distinct)
    del words, distinct
    yield keys, keys, counts
    begin = (np.cumsum(lengths) - lengths)[lengths > 0]
    parts = [np.arange(1, len(word))]  # numbers of the words of each distinct n-gram
    for n in range(1, order):
        pairs = np.zeros(len(own), np.int64)
        pairs[n:] = own[:-n]
        for k in range(n):  # tokens with fewer than n before them
            pairs[(begin + k)[lengths[lengths > 0] > k]] = 0
        pairs <<= 32
        pairs |= back
        if n + 1 < order:
            pairs, back, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            back = back.astype(np.int32)
        else:
            del own, back
            pairs.sort()
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else pairs
            counts = np.diff(first, append=len(pairs))
            pairs = pairs[first]
        first, rest = pairs >> 32, pairs & (1 << 32) - 1
        keys, parts = joined(word[first], keys[rest]), [first, *(p[rest] for p in parts)]
        past = mixed(word[parts[-2]])
        for part in parts[-3::-1]:
            past = joined(word[part], past)
        yield keys, past, counts


def _partials(order: int, shards: int) -> Callable:
    """Distinct n-grams of a task with their histories and counts, packed by shard and length."""

    def packed(words: list[np.ndarray], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        each = counted(np.concatenate(words), np.concatenate(lengths), order)
        words.clear()
        for n, (keys, past, counts) in enumerate(each, 1):
            yield _packed(
                [
                    (p, n, own.tobytes(), before.tobytes() if n > 1 else b"", number.tobytes())
                    for p, own, before, number in _by_shard(keys, shards, past, counts.astype(np.uint32))
                ],
                ["shard", "n", "keys", "past", "a"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(1)
        words: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for texts, own in blocks(utf8(batch.column(0)), lambda t: hashes.of([*lowered(t), END])):
                words += texts
                lengths.append(own)
                size += int(own.sum())
                if size >= COUNT_TOKENS:
                    yield from packed(words, lengths)
                    words, lengths, size = [], [], 0
        if size:
            yield from packed(words, lengths)

    return count


def _joined(group: pa.Table, name: str, kind, rows: np.ndarray | None = None) -> np.ndarray:
    """The numbers that a column's rows hold, by default all rows, end to end; they are copied once."""
    column = group[name]
    rows = range(len(column)) if rows is None else rows.tolist()
    return np.concatenate([np.frombuffer(column[k].as_buffer(), kind) for k in rows])


_SHARD = "kind long, shard long, keys binary, a binary, b binary"
_GRAM, _PAST, _WORD = 0, 1, 2


def _shard_made(shards: int) -> Callable:
    """All partial counts of a shard to its bits, its words, and counts of histories by their shard."""

    def make(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        all_keys, all_counts, rows = [], [], []
        length = group["n"].to_numpy()
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            keys, counts = _joined(group, "keys", np.uint64, own), _joined(group, "a", np.uint32, own).astype(np.int64)
            if n > 1:
                past = _joined(group, "past", np.uint64, own)
                order = np.argsort(keys)
                keys, counts, past = keys[order], counts[order], past[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys, counts, past = keys[first], np.add.reduceat(counts, first), past[first]
                before, followers, total = _summed(past, np.ones(len(past), np.int64), counts)
                for p, h, f, t in _by_shard(before, shards, followers, total):
                    rows.append((_PAST, p, h.tobytes(), f.tobytes(), t.tobytes()))
            else:
                keys, counts = _summed(keys, counts)
                rows.append((_WORD, shard, keys.tobytes(), counts.tobytes(), b""))
            all_keys.append(keys)
            all_counts.append(counts)
        bits = built(np.concatenate(all_keys), np.concatenate(all_counts))
        rows.append((_GRAM, shard, b"", bits, b""))
        return pa.Table.from_batches([_packed(rows, ["kind", "shard", "keys", "a", "b"])])

    return make


def _past_made(group: pa.Table) -> pa.Table:
    """All counts of a shard's histories to its bits."""
    past, followers, total = _summed(*(_joined(group, c, t) for c, t in (("keys", np.uint64), ("a", np.int64), ("b", np.int64))))
    bits = built(np.concatenate([past ^ _FOLLOWERS, past ^ _TOTAL]), np.concatenate([followers, total]))
    rows = [(_PAST, group["shard"][0].as_py(), b"", bits, b"")]
    return pa.Table.from_batches([_packed(rows, ["kind", "shard", "keys", "a", "b"])])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
            columns = [pa.array(np.frombuffer(v, np.int64)) for v in (keys, counts)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "n"])


@dataclass(frozen=True)
class LanguageModel:
    """Exact totals, the filter's shards ``(kind, shard, bits)``, and exact counts ``(word, n)``.

    A word is known by its XXH64; two of the words of a corpus share one with a chance of about
    distinct ** 2 / 2 ** 65.
    """

    order: int
    tokens: int
    distinct: int
    shards: int
    filter_bytes: int
    filter: DataFrame
    words: DataFrame


def train(docs: DataFrame, text: str = "text", order: int = 2, shard_tokens: int = SHARD_TOKENS) -> LanguageModel:
    """Count all n-grams of whole texts up to ``order`` and build the filter.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and each text ends with an end token;
    null texts are empty. N-grams are counted in each task before they move, and are sharded by
    their own hash, so neither a frequent n-gram nor a frequent history gathers in one task.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    tokens = docs.agg(F.sum(word_count(whole) + 1)).first()[0] or 0
    shards = max(1, math.ceil(tokens * order / shard_tokens))
    partial = docs.select(whole.alias("text")).mapInArrow(
        _partials(order, shards), "shard long, n long, keys binary, past binary, a binary"
    )
    made = stored(partial.groupBy("shard").applyInArrow(_shard_made(shards), _SHARD), "counted")
    past = made.where(F.col("kind") == _PAST).groupBy("shard").applyInArrow(_past_made, _SHARD)
    bits = made.where(F.col("kind") == _GRAM).unionByName(stored(past, "histories"))
    bits = bits.select("kind", "shard", F.col("a").alias("bits"))
    words = made.where(F.col("kind") == _WORD).select("keys", "a").mapInArrow(_unpacked, "word long, n long")
    words = stored(words, "words")
    filter_bytes = bits.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    return LanguageModel(order, tokens, words.count(), shards, filter_bytes, bits, words)


def _needed(words: np.ndarray, lengths: np.ndarray, order: int, least: int = 1) -> list[tuple[int, np.ndarray]]:
    """Kind and keys of all that the tokens' probabilities read, in the order ``_logs`` takes.

    Only n-grams and histories of at least ``least`` words.
    """
    asked = [(_GRAM, g) for g in grams(words, lengths, order)[least - 1 :]]
    for h in histories(words, lengths, order)[least - 1 :] if order > least else []:
        asked += [(_PAST, h ^ _FOLLOWERS), (_PAST, h ^ _TOTAL)]
    return asked


def _logs(read: list[np.ndarray], order: int, tokens: int, distinct: int) -> np.ndarray:
    """log10 of each token's Witten-Bell probability, interpolated over the orders."""
    p = (read[0] + distinct / (distinct + 1)) / (tokens + distinct) if tokens else np.ones(len(read[0]))
    for n in range(1, order):
        followers, total = read[order + 2 * (n - 1)], read[order + 2 * (n - 1) + 1]
        seen = np.minimum(read[n], total)
        known = (total > 0) & (followers > 0)
        p = np.where(known, (seen + followers * p) / np.maximum(total + followers, 1), p)
    return np.log10(np.minimum(p, 1))


def _read(keys: np.ndarray, count: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Counts for all keys; equal keys are probed once."""
    distinct, back = np.unique(keys, return_inverse=True)
    return count(distinct)[back]


class _Words(dict):
    """Numbers of words, from 1 on, and columns of what is read of a word alone: once, while it is kept.

    ``read`` gives the columns for words by their XXH64, the count first; 0 is the start sign. Of more
    than CACHE_WORDS words those of the highest counts stay, half as many at most, under new numbers.
    """

    def __init__(self, read: Callable[[np.ndarray], list[np.ndarray]]):
        super().__init__()
        self.read, self.new, self.columns = read, [int(_START)], None

    def __missing__(self, word) -> int:
        self.new.append(xxhash.xxh64_intdigest(word, 1))
        number = self[word] = len(self) + 1
        return number

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """Numbers of each text's words and its end."""
        if len(self) > CACHE_WORDS:
            self._thin()
        out = []
        for raw in texts:
            words = [*lowered(raw), END]
            out.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        return out

    def _thin(self) -> None:
        columns, most = self.table(), CACHE_WORDS // 2
        count = columns[0][1:]
        kept = np.flatnonzero(count > np.partition(count, len(count) - most - 1)[len(count) - most - 1]) + 1
        words = list(self)  # in the order of their numbers
        self.clear()
        self.update((words[old - 1], new) for new, old in enumerate(kept.tolist(), 1))
        self.columns = [c[np.concatenate([[0], kept])] for c in columns]

    def table(self) -> list[np.ndarray]:
        """The columns, by number."""
        if self.new:
            added, self.new = self.read(np.array(self.new, np.uint64)), []
            old = self.columns
            self.columns = added if old is None else [np.concatenate(pair) for pair in zip(old, added)]
        return self.columns


_SCORED = "struct<n_tokens: bigint, n_known: bigint, logs: double, score: double, rare: array<bigint>>"


def _in_head(keys: np.ndarray, head: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word is a head word, and the log of its count and one; 0 for others."""
    known, counts = (values[:-1] for values in head)
    at = np.searchsorted(known, keys)
    inside = np.zeros(len(keys), bool)
    ok = at < len(known)
    inside[ok] = known[at[ok]] == keys[ok]
    log = np.zeros(len(keys))
    log[inside] = np.log10(counts[at[inside]] + 1)
    return inside, log


def _scored(lengths: np.ndarray, words: np.ndarray, logs: np.ndarray, inside: np.ndarray, log: np.ndarray) -> list[tuple]:
    """Per text: tokens, known words and log counts among the head words, score, and other words."""
    rows, end = [], 0
    for n in lengths:
        own = slice(end, end := end + int(n))
        rows.append((int(n), int(inside[own].sum()), float(log[own].sum()), float(logs[own].sum()),
                     mixed(words[own][~inside[own]]).view(np.int64)))  # as n-grams of one word are counted
    return rows


def _scorer(
    filters: dict[int, Filter], head: tuple[np.ndarray, np.ndarray], order: int, tokens: int, distinct: int
) -> Callable[[pa.Array], pa.StructArray]:
    """Scores texts by the filter; what is read of a word alone is kept with the word."""

    def read(hashes: np.ndarray) -> list[np.ndarray]:
        keys = mixed(hashes)
        past = [filters[_PAST].counts(keys ^ sign) for sign in (_FOLLOWERS, _TOTAL)] if order > 1 else []
        return [filters[_GRAM].counts(keys), *past, hashes, *_in_head(keys, head)]

    known = _Words(read)

    def score_texts(texts: pa.Array) -> pa.StructArray:
        rows = []
        for cut, _ in blocks(utf8(texts), lambda t: t, SCORED_BYTES):
            numbers = known.numbers(cut)
            lengths = np.array([len(n) for n in numbers], np.int64)
            own = np.concatenate(numbers)
            *alone, hashes, inside, log = known.table()
            words = hashes[own]
            asked = _needed(words, lengths, order, 2)
            before = np.roll(own, 1)
            before[np.cumsum(lengths) - lengths] = 0
            longer = []
            while asked:
                kind, keys = asked.pop(0)
                longer.append(_read(keys, filters[kind].counts))
                del keys
            read = [alone[0][own], *longer[: order - 1], *(values[before] for values in alone[1:]), *longer[order - 1 :]]
            rows += _scored(lengths, words, _logs(read, order, tokens, distinct), inside[own], log[own])
        return _struct(rows)

    return score_texts


def _struct(rows: list[tuple]) -> pa.StructArray:
    rare = [r[4] for r in rows]
    offsets = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
    flat = pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64), pa.int64())
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    names = ["n_tokens", "n_known", "logs", "score", "rare"]
    return pa.StructArray.from_arrays([*columns, pa.ListArray.from_arrays(offsets, flat)], names)


@dataclass(frozen=True)
class _Sent:
    """An array that every task reads: a file in the shared folder to map, or a broadcast of bytes."""

    kind: str
    path: str | None
    broadcast: Any

    def array(self) -> np.ndarray:
        if self.path is None:
            return np.frombuffer(self.broadcast.value, self.kind)
        return np.asarray(np.memmap(self.path, self.kind, "r"))


def _mounted(df: DataFrame) -> bool:
    """Whether the files that ``df`` is read from lie in a mounted folder, which tasks can map."""
    files = df.inputFiles()
    return bool(files) and all(f.startswith("file:") for f in files)


def _sent(spark: SparkSession, parts: Iterable[bytes], kind: str, mounted: bool) -> _Sent:
    """Parts end to end, written a part at a time where the shared folder is mounted."""
    if not mounted:
        return _Sent(kind, None, spark.sparkContext.broadcast(b"".join(parts)))
    path = unquote(urlparse(work_path(spark, "mapped")).path)
    with open(path, "wb") as out:
        for part in parts:
            out.write(part)
    return _Sent(kind, path, None)


def _sent_filter(model: LanguageModel, mounted: bool) -> tuple[_Sent, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The filter's bytes, and where each kind's shards begin and how many bytes they have.

    Shards lie in the order they come in; a missing one reads the 8 bytes of zero at the beginning.
    """
    places = {k: (np.zeros(model.shards, np.int64), np.full(model.shards, 8, np.int64)) for k in (_GRAM, _PAST)}

    def parts() -> Iterator[bytes]:
        yield bytes(8)
        at = 8
        for row in model.filter.toLocalIterator():
            begin, size = places[row["kind"]]
            begin[row["shard"]], size[row["shard"]] = at, len(row["bits"])
            at += len(row["bits"])
            yield bytes(row["bits"])

    return _sent(model.filter.sparkSession, parts(), "u1", mounted), places


def _head(model: LanguageModel, most: int, mounted: bool) -> tuple[_Sent, _Sent]:
    """Keys in order and counts of the most frequent words: ``most`` at most.

    Words are counted by the size of their count first, so no task sorts or sends more than is taken.
    """
    size = F.floor(F.log("n") / math.log(_BASE))
    sizes = sorted(model.words.groupBy(size.alias("size")).count().collect(), reverse=True)
    least, taken = math.inf, 0
    for at, count in sizes:
        if (taken := taken + count) > most:
            break
        least = at
    rows = model.words.where(size >= F.lit(float(least))).toArrow()
    keys, counts = rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    spark = model.words.sparkSession
    # eight bytes more, which are not read, as an empty file can't be mapped
    return (
        _sent(spark, [keys[order].tobytes(), bytes(8)], "u8", mounted),
        _sent(spark, [counts[order].tobytes(), bytes(8)], "f8", mounted),
    )


def score(
    docs: DataFrame, model: LanguageModel, text: str = "text", head_words: int = HEAD_WORDS,
    sent_bytes: float | None = None, map_files: bool | None = None,
) -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    ``score`` is the model's log10 probability of the whole text with its end. ``base_score`` sums
    log10((c + 1) / (N + V + 1)) with exact counts; ``n_known`` counts tokens with c > 0. Null
    texts are empty: one end token. All other columns stay, under any name; a column of a result's
    name is replaced. A model of no tokens gives a score of 0.

    A filter of at most ``sent_bytes`` is given to all tasks, as a mapped file or a broadcast
    (``map_files``; by default mapped where the shared folder is a mounted one). By default a mapped
    file may have any size.
    """
    mounted = _mounted(model.filter) if map_files is None else map_files
    if sent_bytes is None:
        sent_bytes = math.inf if mounted else BROADCAST_BYTES
    kept = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "base_score", "score")]
    own = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(0)
    docs = docs.select(own.alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    head = _head(model, head_words, mounted)
    sizes = (model.order, model.tokens, model.distinct)

    if model.filter_bytes <= sent_bytes:
        sent, places = _sent_filter(model, mounted)

        @F.arrow_udf(_SCORED)
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            bits, top = sent.array(), tuple(h.array() for h in head)
            filters = {kind: Filter.of(bits, *at) for kind, at in places.items()}
            score_texts = _scorer(filters, top, *sizes)
            for texts in batches:
                yield score_texts(texts)

        found = docs.select("own", scored("text").alias("s"))
    else:
        found = _scored_by_shard(docs, model, head)
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = found.select("row", F.explode("s.rare").alias("word"))
    rare = rare.groupBy("row", "word").agg(F.count("*").alias("times"))
    known = rare.join(model.words.withColumnRenamed("word", "of"), F.col("word") == F.col("of"))
    known = known.groupBy(F.col("row").alias("known_row")).agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs")
    )
    share = math.log10(model.tokens + model.distinct + 1)
    logs = F.col("s.logs") + F.coalesce("rare_logs", F.lit(0.0))
    return found.join(known, F.col("row") == F.col("known_row"), "left").select(
        *(F.col("own").getField(c).alias(c) for c in kept), F.col("s.n_tokens").alias("n_tokens"),
        (F.col("s.n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (logs - F.col("s.n_tokens") * share).alias("base_score"), F.col("s.score").alias("score"),
    )


def _scored_by_shard(docs: DataFrame, model: LanguageModel, head: tuple[_Sent, _Sent]) -> DataFrame:
    """The same for a filter too large to send: keys go to the shards, counts come back.

    Rows are one text's distinct keys of one shard; a shard meets the rows in portions of about a
    million keys, so neither a shard nor a text is more than a task can hold.
    """
    sizes, shards = (model.order, model.tokens, model.distinct), model.shards
    docs = stored(docs.withColumn("text_row", F.monotonically_increasing_id()), "texts")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(1)
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = hashes.of([*lowered(raw), END])
                asked: dict[int, list] = {}
                for kind, keys in _needed(words, np.array([len(words)]), sizes[0]):
                    asked.setdefault(kind, []).append(keys)
                rows = []
                for kind, keys in asked.items():
                    for p, own in _by_shard(np.unique(np.concatenate(keys)), shards):
                        rows.append((row, kind, p, own.tobytes()))
                yield _packed(rows, ["row", "kind", "shard", "keys"])

    asks = docs.select("text_row", "text").mapInArrow(ask, "row long, kind long, shard long, keys binary")
    portions = max(1, math.ceil(model.tokens * 3 * model.order / shards / 1_000_000))
    asks = asks.withColumn("portion", F.pmod(F.xxhash64("row"), F.lit(portions)))
    filters = model.filter.withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1)))).select(
        "kind", "shard", F.col("portion").cast("long").alias("portion"), "bits"
    )

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        bits = right["bits"][0].as_py() if len(right) else bytes(8)
        held = Filter.of(np.frombuffer(bits, np.uint8), np.zeros(1, np.int64), np.array([len(bits)]))
        rows = [
            (row, kind, keys, held.counts(np.frombuffer(keys, np.uint64)).tobytes())
            for row, kind, keys in zip(*(left[c].to_pylist() for c in ("row", "kind", "keys")))
        ]
        return pa.Table.from_batches([_packed(rows, ["row", "kind", "keys", "a"])])

    by = ("kind", "shard", "portion")
    answers = asks.groupBy(*by).cogroup(filters.groupBy(*by)).applyInArrow(
        answer, "row long, kind long, keys binary, a binary"
    )
    answers = answers.groupBy("row").agg(F.collect_list(F.struct("kind", "keys", "a")).alias("read"))
    both = docs.join(stored(answers, "answers"), F.col("text_row") == F.col("row"))

    @F.arrow_udf(_SCORED)
    def scored(texts: pa.Array, reads: pa.Array) -> pa.Array:
        hashes, rows, top = WordHashes(1), [], tuple(h.array() for h in head)
        for raw, parts in zip(utf8(texts), reads):
            words, table = hashes.of([*lowered(raw), END]), {}
            for kind in (_GRAM, _PAST):
                own = [p for p in parts.as_py() if p["kind"] == kind]
                keys = np.frombuffer(b"".join(p["keys"] for p in own), np.uint64)
                order = np.argsort(keys)
                table[kind] = keys[order], np.frombuffer(b"".join(p["a"] for p in own), np.float64)[order]
            lengths = np.array([len(words)])
            asked = _needed(words, lengths, sizes[0])
            read = [table[kind][1][np.searchsorted(table[kind][0], keys)] for kind, keys in asked]
            rows += _scored(lengths, words, _logs(read, *sizes), *_in_head(mixed(words), top))
        return _struct(rows)

    return both.select("own", scored("text", "read").alias("s"))
