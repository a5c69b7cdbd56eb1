import re
from collections import Counter

import numpy as np
import pytest

from granary.llm import decontaminate, mixing


def cut(text):
    return re.findall(r"\w+", (text or "").lower())


def brute(docs, items, threshold=0.8):
    out = []
    for d, text in docs:
        words = cut(text)
        for i, item in items:
            own = cut(item)
            width = min(5, len(own))
            if not width:
                continue
            wanted = {tuple(own[k : k + width]) for k in range(len(own) - width + 1)}
            have = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
            shared = len(wanted & have)
            if shared >= threshold * len(wanted) - 1e-9:
                out.append((d, i, len(wanted), shared))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def benchmark_case(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"v{rng.integers(0, 3_000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 4, 5, 7, 12, 40, 40, 90, 400])]
    items += [(20, ""), (21, None), (22, items[5][1]), (None, items[4][1]), (23, "same same same same same same same")]
    docs = []
    for i in range(60):
        words = [word() for _ in range(int(rng.choice([0, 3, 60, 800])))]
        if i % 2:
            own = cut(items[int(rng.integers(0, 9))][1])
            for at in rng.choice(len(own), min(len(own), int(rng.integers(0, 4))), replace=False):
                own[at] = word()
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = [w.upper() + "," for w in own]
        docs.append((i, " ".join(words)))
    docs += [(60, None), (61, "same " * 9), (61, "same " * 9), (None, items[3][1])]
    return (
        docs, items, spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize("part", [1_000_000, 60])
def test_containment_equals_brute_force(benchmark_case, part):
    docs, items, doc_table, item_table = benchmark_case
    found = decontaminate.contaminated(doc_table, item_table, part_shingles=part).collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == brute(docs, items)
    kept = decontaminate.without_items(doc_table, item_table, part_shingles=part)
    hit = {(d, t) for d, t in docs if brute([(d, t)], items)}
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in docs if r not in hit), key=str)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert decontaminate.contaminated(odd_docs, items).count() == 3
    kept = decontaminate.without_items(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == 9
    assert decontaminate.without_items(odd_docs, items.where("false")).count() == 12
    assert decontaminate.contaminated(odd_docs, items.where("false")).count() == 0
    assert decontaminate.contaminated(no_docs, items).count() == 0


def test_targets_share_the_excess():
    got = mixing.targets([("b", 100), (None, 400), ("a", 10), ("c", 0)], weights=(3, 1, 2))
    assert got["a"] == 20 and got["c"] == 0 and sum(got.values()) == pytest.approx(765)
    assert got["b"] <= 200 and got[None] <= 800
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1_000])
def test_permutations(n):
    for seed in (1, 2):
        assert sorted(mixing.permuted(np.arange(n), n, [seed, 3]).tolist()) == list(range(n))


@pytest.fixture(scope="module")
def sources(spark):
    rng = np.random.default_rng(9)
    rows = [
        (i, " ".join(f"d{i}_{k}" for k in range(int(rng.choice([0, 1, 5, 300, 2_000])))), rng.choice(["x", "y", "z"]))
        for i in range(120)
    ]
    rows = [(i, t, None if i % 10 == 0 else str(s)) for i, t, s in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_meets_its_targets(sources):
    found = mixing.taken_words(sources, length=16, slots=64)
    rows = found.collect()
    assert len(rows) == 120 and all(r["taken"] <= 2 * r["size"] for r in rows)
    texts = {r["doc_id"]: r for r in sources.collect()}
    by: dict = {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]]["text"] or "").split())
        by.setdefault(texts[r["doc_id"]]["source"], []).append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.02, abs=32)
    again = mixing.taken_words(sources.repartition(5), length=16, slots=64)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_blocks_hold_what_is_counted(sources):
    mix = mixing.mixed_blocks(sources, length=16, slots=64).collect()
    counted = {r["doc_id"]: r["taken"] for r in mixing.taken_words(sources, length=16, slots=64).collect()}
    held = Counter(int(w[1:].split("_")[0]) for r in mix for w in r["text"].split())
    assert {k: n for k, n in counted.items() if n} == dict(held)
    assert all(r["n_words"] == len(r["text"].split()) <= 16 for r in mix)
    assert len({(r["shard"], r["slot"]) for r in mix}) == len(mix)
    shards = Counter(r["shard"] for r in mix)
    assert all(n == 64 for s, n in shards.items() if s < max(shards))


def test_odd_rows_in_a_mix(odd_docs, no_docs):
    rows = mixing.taken_words(odd_docs, length=4).collect()
    assert len(rows) == 12 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mixed_blocks(odd_docs, length=4).count() > 0
    assert mixing.taken_words(no_docs).count() == 0 and mixing.mixed_blocks(no_docs).count() == 0
