import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from granary.llm import exact, search


def same(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_groups(rows):
    """Sorted (doc_id, keep_id, group_size, text_sha256) and how many rows stay."""
    groups = {}
    for key, text in rows:
        groups.setdefault(same(text), []).append(key)
    out = []
    for text, keys in groups.items():
        keep = min((k for k in keys if k is not None), default=None)
        out += [(k, keep, len(keys), hashlib.sha256(text.encode()).hexdigest()) for k in keys]
    return sorted(out, key=str), len(groups)


def found_groups(frame):
    rows = frame.collect()
    for r in rows:
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    columns = ("doc_id", "keep_id", "group_size", "text_sha256")
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str), sum(r["kept"] for r in rows)


@pytest.mark.parametrize("first, bits, group_rows", [(4096, 1 << 26, 10_000), (4, 64, 3)])
def test_exact_groups_equal_brute_force(spark, odd_docs, first, bits, group_rows):
    stem = "The same start of many texts, " * 40
    more = [(100 + i, stem + "ends"[: i % 5]) for i in range(23)] + [(200 + i, stem[: 7 * i]) for i in range(30)]
    more += [(300 + i, "  hot\tcopy \n") for i in range(40)] + [(400, " hot copy "), (401, "hot copy"), (402, None)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    found = exact.exact_duplicates(docs.repartition(5), first=first, bits=bits, group_rows=group_rows)
    assert found_groups(found) == plain_groups([tuple(r) for r in docs.collect()])


def test_exact_takes_string_keys_clashing_names_and_nothing(spark, odd_docs, no_docs):
    named = odd_docs.select("text", F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("rest"), F.lit(2).alias("n"))
    got = found_groups(exact.exact_duplicates(named))
    assert got == plain_groups([(r["doc_id"], r["text"]) for r in named.collect()])
    assert exact.exact_duplicates(no_docs).count() == 0


def cut(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranking(docs, items, k):
    docs = [(key, cut(text)) for key, text in docs]
    docs = [(key, words) for key, words in docs if words]
    n_docs, total = len(docs), sum(len(w) for _, w in docs)
    out = []
    for item, text in items:
        scored = []
        for key, words in docs:
            m = 75 + (25 * len(words) * n_docs) // total
            score = 0
            for term in cut(text):
                df = sum(term in w for _, w in docs)
                if term in words:
                    tf = words.count(term)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, key is None, key))
        out += [(item, r + 1, key, -s) for r, (s, _, key) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, block_terms", [(3, 1_000_000), (50, 8)])
def test_ranking_equals_brute_force(spark, k, block_terms, monkeypatch):
    import random

    rng = random.Random(5)
    words = ["Ab", "ab", "c1", "dé", "É", "x_y", "😀", "zz", "the", "of"] + [f"w{i}" for i in range(70)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)]
    docs += [(7, "the the the of"), (None, "ab c1 ab"), (500, None), (501, ""), (502, "dé " * 3000), (503, ",;.")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 90)))) for i in range(12)]
    items += [(3, "the of the"), (None, "ab zz"), (90, None), (91, "unseen"), (92, "!")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("item", F.lit(2))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1.5))
    found = search.ranked_documents(frame.repartition(3), asked, k=k, block_terms=block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_ranking(docs, items, k)


def test_ranking_of_long_texts_in_pieces_and_of_nothing(spark, no_docs, monkeypatch):
    text = ("Word, other;" * 5000).encode()
    whole = [w for words in search.cut_terms(text) for w in words]
    monkeypatch.setattr(search, "PIECE", 100)
    assert [w for words in search.cut_terms(text) for w in words] == whole and len(whole) == 10_000
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert search.ranked_documents(no_docs, items).count() == 0
    assert search.ranked_documents(no_docs.limit(0), items.limit(0)).count() == 0
