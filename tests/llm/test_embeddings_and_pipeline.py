import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import embeddings
from granary.llm.common import lowest

SMALL = "/root/testdata/sf0.001"


def brute(vectors, cosine=0.95):
    ids = [i for i, _ in vectors]
    near = {i: 0 for i in ids}
    root = {i: i for i in ids}

    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(vectors):
        for b, y in vectors[k + 1 :]:
            if usable(x) and usable(y) and len(x) == len(y):
                x1, y1 = np.array(x) / max(map(abs, x)), np.array(y) / max(map(abs, y))
                if x1 @ y1 / np.linalg.norm(x1) / np.linalg.norm(y1) >= cosine:
                    near[a] += 1
                    near[b] += 1
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {i: (near[i], find(i), find(i) == i) for i in ids}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(10)
    out = []
    for family in range(40):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 9))):
            out.append((centre + rng.normal(size=24) * rng.choice([0, 0.05, 0.3])).tolist())
    out += [out[0]] * 30 + [[0.0] * 24, [1.0] * 5, [2.0] * 5, [1e-200] * 24, [1e200] * 24, None, []]
    out += [[float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    order = rng.permutation(len(out))
    return [(int(k), out[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("block", [4_096, 16])
def test_links_equal_brute_force(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = {r[0]: tuple(r)[1:] for r in embeddings.near_vectors(table).collect()}
    assert found == brute(vectors)


def test_odd_vectors(spark, vectors):
    table = spark.createDataFrame([(None, [1.0, 2.0]), (None, None), (4, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found = sorted(map(tuple, embeddings.near_vectors(table).collect()), key=str)
    assert found == sorted([(None, 0, None, False), (None, 0, None, False), (4, 0, 4, True)], key=str)
    assert embeddings.near_vectors(table.where("false")).count() == 0


def test_asked_lists_by_bundle():
    asks = [np.array([0, 1, 5]), np.array([5]), np.array([2, 3, 4, 11])]
    assert embeddings._bundled(asks, 3).to_pylist() == [[[0, 1], [5]], [[5]], [[2], [3, 4], [11]]]


def test_rows_of_lowest_hash(spark):
    rows = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    for limit in (1, 50, 30_000):
        expected = [r["id"] for r in rows.orderBy("h").limit(limit).collect()]
        assert [r["id"] for r in lowest(rows, F.col("h"), ["id"], limit, 20_000).collect()] == expected


def test_recall_of_probes():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(4_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    step = rng.normal(size=base.shape)
    step -= (step * base).sum(axis=1, keepdims=True) * base
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    partner = base * 0.951 + step * math.sqrt(1 - 0.951**2)
    index = embeddings.fit_index(base[:1_000], 50_000, 0.95)
    asks = embeddings.encoded(base, index)[3]
    lists, code, error, _ = embeddings.encoded(partner, index)
    assert np.mean([lists[i] in asks[i] for i in range(len(base))]) > 0.99
    for i in range(0, 200):
        a, b = embeddings.linked(
            base[i : i + 1], partner[i : i + 1], code[i : i + 1], error[i : i + 1], lists[i : i + 1],
            np.array([[True]]), index, 0.95,
        )
        assert len(a) == 1


@pytest.mark.parametrize("dims, inner", [(64, 8), (256, 8)])
def test_probes_of_vectors_in_few_dimensions(dims, inner):
    rng = np.random.default_rng(12)
    plane = np.linalg.qr(rng.normal(size=(dims, inner)))[0].T
    base = rng.normal(size=(4_000, inner))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    step = rng.normal(size=base.shape)
    step -= (step * base).sum(axis=1, keepdims=True) * base
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    partner = (base * 0.951 + step * math.sqrt(1 - 0.951**2)) @ plane
    base = base @ plane
    index = embeddings.fit_index(base[:2_000], 40_000, 0.95)
    asks = embeddings.encoded(base, index)[3]
    lists = embeddings.encoded(partner, index)[0]
    assert all(lists[i] in asks[i] for i in range(len(base)))


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, labels, tmp_path):
    folder = str(tmp_path)
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "two words")], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, folder)
            assert kept.columns == docs.columns, name
            assert kept.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).count()
    assert corpus_pipeline.run(spark, folder).columns[:3] == ["shard", "slot", "source"]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")
def test_pipeline_keeps_and_drops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
    n = kept.count()
    assert 0 < n < docs.count() and kept.select("text").distinct().count() == n
    mix = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    assert {i for r in mix for i in r["ids"]} <= {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "mixing"]


def test_near_fingerprints_are_dropped_by_the_pipeline(spark):
    refrain = "over hills and far away " * 80  # five shingles, so no bit is tied
    tails = [" ".join(f"{c}{i}" for i in range(12)) for c in "ab"]
    other = " ".join(f"word{i}" for i in range(300))
    rows = [(1, refrain + tails[0]), (2, refrain + tails[1]), (3, other), (4, other.replace("word7 ", "new "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
