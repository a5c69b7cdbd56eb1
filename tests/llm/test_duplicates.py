import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import similar, simhash
from granary.llm.components import components


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_hubs_and_nothing(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(1, i) for i in range(2, 80)]
    pairs += [tuple(map(int, p)) for p in rng.integers(300, 600, (150, 2))] + [(7, 7)]
    links = spark.createDataFrame([*pairs, (None, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    expected = groups(pairs, {n for p in pairs for n in p})
    assert found == {n: r for n, r in expected.items() if n != r}
    assert components(links.where("a < 0")).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)] if words else []
    bits = [sum(h >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
    return sum(1 << b for b, on in enumerate(bits) if on)


def test_fingerprints_and_odd_rows(odd_docs, no_docs):
    texts = {r["text"] for r in odd_docs.collect()}
    for text in texts:
        assert simhash.fingerprint_of((text or "").encode()) % 2**64 == plain_fingerprint(text)
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == 12
    named = [(r["doc_id"], r["component_id"]) for r in found]
    assert named.count((2, 1)) == 2 and (4, 3) in named and (5, 3) in named
    assert (None, 7) in named and (None, None) in named
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("list_limit", [512, 3])
def test_links_equal_brute_force(spark, list_limit):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    fps = [int(b) for b in base]
    for b in base[:20]:  # families of near fingerprints, and chains
        for _ in range(12):
            last = int(rng.choice(fps[-12:])) if rng.random() < 0.3 else int(b)
            for bit in rng.integers(0, 64, rng.integers(1, 4)):
                last ^= 1 << int(bit)
            fps.append(last)
    fps = np.unique(np.array(fps, np.uint64))
    signed = fps.astype(np.int64).tolist()
    prints = spark.createDataFrame(list(zip(signed, range(len(signed)))), "fp long, id long")
    links = simhash.fingerprint_links(prints, list_limit)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    expected = groups([tuple(map(int, p)) for p in near], range(len(fps)))
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {n: r for n, r in expected.items() if n != r}


@pytest.mark.parametrize("segments", [16, 32])
def test_near_points_share_a_grid_point(spark, segments):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 200)
    b = [int(x) ^ (1 << int(i)) ^ (1 << int(j)) for x, i, j in zip(a, *rng.integers(0, 62, (2, 200)))]
    pairs = spark.createDataFrame([(int(x), y) for x, y in zip(a, b)], "a long, b long")
    shared = F.arrays_overlap(simhash.grid_points("a", segments), simhash.grid_points("b", segments))
    assert pairs.where(~shared).count() == 0


def copies():
    rng = np.random.default_rng(6)
    rows, key = [], 0
    for family in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5_000, 200)]
        for copy in range(4):
            own = list(words)
            for at in rng.choice(200, copy, replace=False):  # up to 3 words of 200
                own[at] = f"c{rng.integers(0, 10**6)}"
            rows.append((key, " ".join(own), family))
            key += 1
    return rows


@pytest.mark.parametrize("block", [1_024, 4])
def test_similar_documents_are_grouped(spark, block):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string, family int")
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs, block=block).collect()}
    assert found == {k: 4 * family for k, _, family in rows}
    kept = similar.one_of_each(docs, similar.similar_documents(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == [4 * f for f in range(25)]


def test_similar_documents_of_odd_rows(odd_docs, no_docs):
    found = similar.similar_documents(odd_docs)
    assert found.count() == 12
    kept = similar.one_of_each(odd_docs, found)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 6, 7, 8] and ids.count(None) == 2
    assert similar.one_of_each(no_docs, similar.similar_documents(no_docs)).count() == 0


def test_columns_of_any_name_stay(odd_docs):
    clashing = ["kept_key", "row_of_key", "own_key", "place", "doc", "turn", "component_id", "mark", "id", "list"]
    odd_docs = odd_docs.select("doc_id", "text")
    docs = odd_docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clashing)])
    kept = similar.one_of_each(docs, similar.similar_documents(docs))
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == 8 and all([r[c] for c in clashing] == list(range(len(clashing))) for r in rows)


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_similar_documents_hold_the_threshold_on_both_sides(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    rows, below, above = [], 0, 0
    for pair in range(300):
        if pair % 3 == 0:  # 4 of 5 shingles
            one = [word() for _ in range(8)]
            two = [*one, word()]
        else:  # a tail of other words: Jaccard similarities of about 0.65 to 0.95
            one = [word() for _ in range(104)]
            cut = int(rng.integers(3, 22))
            two = one[:-cut] + [word() for _ in range(cut)]
        rows += [(2 * pair, " ".join(one)), (2 * pair + 1, " ".join(two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs).collect()}
    missed = 0
    for (a, one), (b, two) in zip(rows[::2], rows[1::2]):
        if jaccard(one, two) < 0.8:
            below += 1
            assert found[b] == b
        else:
            above += 1
            missed += found[b] != a
    assert below > 50 and above > 150 and missed <= 0.02 * above
