import math
import tracemalloc
from collections import Counter
from dataclasses import replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import lm
from granary.llm.common import WordHashes, fold
from granary.session import CLEANUP

SMALL = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), b" end"]


def brute(rows):
    counts = Counter(t for _, text in rows for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for key, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        out.append((key, len(own), sum(counts[t] > 0 for t in own), base))
    return total, out


@pytest.mark.parametrize("head, sent, mapped", [(1_000_000, 1 << 30, True), (3, 1 << 30, False), (0, 1 << 30, None), (3, 0, None)])
def test_exact_columns_and_all_ways(odd_docs, head, sent, mapped):
    model = lm.train(odd_docs, shard_tokens=20_000)
    assert model.shards > 1
    found = lm.score(odd_docs, model, head_words=head, sent_bytes=sent, map_files=mapped).collect()
    total, expected = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert model.tokens == total
    order = lambda r: (str(r[0]), r[1], round(r[3], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in found), key=order)
    for a, b in zip(got, sorted(expected, key=order), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert {"lang", "source", "id"} <= set(found[0].asDict())


def test_both_ways_give_the_same_scores(odd_docs):
    model = lm.train(odd_docs, shard_tokens=20_000, order=3)
    one, two, three = (
        sorted(r["score"] for r in lm.score(odd_docs, model, sent_bytes=n, map_files=mapped).collect())
        for n, mapped in ((1 << 30, True), (1 << 30, False), (0, True))
    )
    assert one == pytest.approx(two, abs=1e-9) and one == pytest.approx(three, abs=1e-9)


def exact_score(own, grams, pasts, order):
    """Witten-Bell from exact counts, as the filter's answers are to come near."""
    total, distinct = pasts[()]
    out, history = 0.0, [b" start"] * (order - 1)
    for t in own:
        p = (grams[(t,)] + distinct / (distinct + 1)) / (total + distinct)
        for n in range(1, order):
            past = tuple(history[len(history) - n :])
            if past in pasts:
                number, followers = pasts[past]
                p = (grams[(*past, t)] + followers * p) / (number + followers)
        out += math.log10(p)
        history = [*history, t][1:] if order > 1 else history
    return out


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")
@pytest.mark.parametrize("order", [2, 3])
def test_scores_come_near_those_of_exact_counts(spark, order):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = fold("doc_id", 7) == 2
    model = lm.train(docs.where(~held), order=order)
    grams = Counter()
    for r in docs.where(~held).collect():
        own = [*[b" start"] * (order - 1), *tokens(r["text"])]
        for at in range(order - 1, len(own)):
            grams.update(tuple(own[at - n : at + 1]) for n in range(order))
    pasts = {}
    for g, count in grams.items():
        number, followers = pasts.get(g[:-1], (0, 0))
        pasts[g[:-1]] = number + count, followers + 1
    texts = {r["doc_id"]: r["text"] for r in docs.where(held).collect()}
    off = []
    for r in lm.score(docs.where(held), model).collect():
        exact = exact_score(tokens(texts[r["doc_id"]]), grams, pasts, order)
        off.append((r["score"] - exact) / r["n_tokens"])
    assert abs(np.mean(off)) < 0.015 and np.abs(off).max() < 0.15


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b", 7, 8, 9, 10, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s int, row int, rare_known int, `a.b` int, row_of_text int")
    model = lm.train(docs)
    for sent in (1 << 30, 0):
        found = lm.score(docs, model, sent_bytes=sent).first().asDict()
        assert (found["s"], found["row"], found["rare_known"], found["a.b"], found["row_of_text"]) == (7, 8, 9, 10, 11)
    assert lm.score(docs.select("text"), model).columns == ["n_tokens", "n_known", "base_score", "score"]


def test_counts_are_read_back_on_a_log_scale():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = np.maximum(1, rng.pareto(0.7, 20_000).astype(np.int64).clip(0, 10**6))
    bits = lm.built(keys, counts)
    held = lm.Filter.of(np.frombuffer(bits, np.uint8), np.zeros(1, np.int64), np.array([len(bits)]))
    read = held.counts(keys)
    off = np.abs(np.log(read / counts))
    assert (off <= np.log(lm._BASE) + 1e-9).mean() > 0.95
    assert (read >= counts / lm._BASE - 1).all()  # a Bloom filter never loses an entry
    strangers = held.counts(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert (strangers > 0).mean() < 0.05


def test_no_texts(odd_docs, no_docs):
    empty = lm.train(no_docs)
    assert empty.tokens == 0
    assert {r["score"] for r in lm.score(odd_docs, empty).collect()} == {0.0}
    assert lm.score(no_docs, lm.train(odd_docs)).count() == 0


def test_held_out_text_like_the_corpus_scores_higher(spark):
    rows = [(i, "the cat sat on the mat and the dog ran") for i in range(30)]
    model = lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "mat the on sat cat the")], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in lm.score(asked, model).orderBy(F.col("doc_id")).collect()}
    assert found[1] > found[2]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_distinct_ngrams_are_those_of_all_positions(order):
    texts = [[], [b"a"], [b"a", b"b", b"a", b"b", b"a"], [b"b"] * 7, [b"c", b"a", b"b"], []]
    hashes = WordHashes(1)
    words = np.concatenate([hashes.of([*t, lm.END]) for t in texts])
    lengths = np.array([len(t) + 1 for t in texts])
    every, pasts = lm.grams(words, lengths, order), lm.histories(words, lengths, order) if order > 1 else []
    for n, (keys, past, counts) in enumerate(lm.counted(words, lengths, order)):
        assert len(set(keys.tolist())) == len(keys)
        expected = Counter(zip(every[n].tolist(), (pasts[n - 1] if n else every[0]).tolist()))
        assert dict(zip(zip(keys.tolist(), past.tolist()), counts.tolist())) == expected


def small_filter(words, order=2):
    bits = {lm._GRAM: [], lm._PAST: []}
    for n, (keys, past, counts) in enumerate(lm.counted(words, np.array([len(words)]), order)):
        bits[lm._GRAM].append((keys, counts))
        if n:
            past, followers, total = lm._summed(past, np.ones(len(past), np.int64), counts)
            bits[lm._PAST] += [(past ^ lm._FOLLOWERS, followers), (past ^ lm._TOTAL, total)]
    made = {}
    for kind, parts in bits.items():
        held = np.frombuffer(lm.built(*(np.concatenate(c) for c in zip(*parts))), np.uint8)
        made[kind] = lm.Filter.of(held, np.zeros(1, np.int64), np.array([len(held)]))
    return made


def test_what_is_read_of_a_word_alone_is_read_once(monkeypatch):
    """Frequent words lie at high levels, so asking for them again in each block was most of the work."""
    common = [f"c{i}" for i in range(50)]
    texts = pa.array([" ".join([*common, f"r{i}", *common]) for i in range(400)])
    words = WordHashes(1).of([w for t in texts.to_pylist() for w in [*t.encode().split(), lm.END]])
    filters, head = small_filter(words), (np.zeros(1, np.uint64), np.zeros(1))
    probed = []
    counts = lm.Filter.counts
    monkeypatch.setattr(lm.Filter, "counts", lambda self, keys: probed.append(len(keys)) or counts(self, keys))

    def scores(asked, **limits):
        probed.clear()
        for name, value in limits.items():
            monkeypatch.setattr(lm, name, value)
        found = lm._scorer(filters, head, 2, len(words), 452)(asked)
        return found.field("score").to_numpy(), sum(probed)

    whole, _ = scores(texts)
    # without keeping, each of 400 blocks reads 52 words three times, and 102 word pairs
    by_text, asked = scores(texts, SCORED_BYTES=1)
    assert (by_text == whole).all() and asked < 400 * (3 + 102) + 3 * 60
    thinned, asked = scores(texts, CACHE_WORDS=120)
    assert (thinned == whole).all() and asked < 400 * (3 + 102) + 3 * 60


def test_a_shard_is_built_in_little_memory():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 1_000_000).astype(np.uint64)
    counts = np.ones(len(keys), np.int64)
    tracemalloc.start()
    bits = lm.built(keys, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(bits) >= 1_250_000 and peak < 40e6


def test_a_filter_of_any_size_is_mapped_in_a_mounted_folder(odd_docs, monkeypatch):
    def refused(*_):
        raise AssertionError("n-grams were taken to the shards")

    model = lm.train(odd_docs)
    monkeypatch.setattr(lm, "_scored_by_shard", refused)
    large = replace(model, filter_bytes=1 << 40)
    assert lm.score(odd_docs, large).count() == odd_docs.count()
    with pytest.raises(AssertionError):
        lm.score(odd_docs, large, map_files=False)


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(k) for k in range(files.size())]
    return {f.getName() for f in files if f.getName().startswith("shuffle_") and f.exists()}


def test_shuffle_files_go_when_a_table_is_stored(spark, odd_docs):
    before = shuffled(spark)
    df = odd_docs.groupBy("lang").count()
    set_before = spark.conf.get(CLEANUP, None)
    held = lm.stored(df, "tested")
    assert not shuffled(spark) - before
    assert sorted(map(str, held.collect())) == sorted(map(str, df.collect()))
    assert spark.conf.get(CLEANUP, None) == set_before
