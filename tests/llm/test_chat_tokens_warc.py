import base64
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.llm import chat, tokens, warc

ODD = [
    "", None, "plain", "a\\|b", "<\\s>", "\\\\<s></s>", "[AND]\n[AND]\n", "\n[AND]\n", " [/INST]\n", "<", "</s", "[INST",
    "é😀[\\INST]", "\\", "</s>[INST] ok [/INST]", "user", "x" * 50_000,
]


def chats():
    rows = []
    for conv in range(6):
        for turn in range(3 * conv):
            role = ["user", "user", "assistant", "system", None, "</s>"][(turn * 7 + conv) % 6]
            rows.append((conv, turn, role, ODD[(turn * 5 + conv) % len(ODD)]))
    rows += [(7, 1, "user", "tie b"), (7, 1, "user", "tie a"), (7, 1, "user", "tie a"), (7, None, "assistant", "first")]
    rows += [(None, 0, "user", "no key"), (None, 1, "assistant", None), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("run", [256, 4, 1])
def test_formatting_reads_back(spark, run):
    rows = chats()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumn("key", F.lit("extra")).withColumn("blocks", F.lit(1))
    found = chat.format_chats(table, run_turns=run)
    found = found.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "loss_spans",
    ).collect()
    assert len(found) == len({r[0] for r in rows})
    for r in found:
        own = [(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]]
        own.sort()
        assert [(t["role"], t["text"]) for t in r["turns"]] == [o[2:] for o in own]
        said = [o[3] for o in own if o[2] == "assistant"]
        assert r["loss"] == "".join(said) and len(r["loss_spans"]) == len(said)
        merged = 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:]))
        assert r["formatted"].count("<s>[INST] ") == merged
    assert chat.format_chats(table.where("false")).count() == 0


def test_formatting_runs_no_python(spark):
    table = spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string")
    found = chat.format_chats(table.where("conv_id > 0"))
    plan = found.select(chat.read_turns(F.col("formatted")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


TOKENIZERS = pytest.importorskip("public_tokenizers")


def test_counts_equal_the_library_and_the_cache_is_used(spark, odd_docs, no_docs, tmp_path):
    from tokenizers import Tokenizer

    path, cache = str(TOKENIZERS.path("word_bpe_49k.json")), str(tmp_path / "cache")
    coder = Tokenizer.from_file(path)
    size = lambda t: len(coder.encode(t or "", add_special_tokens=False).ids)
    found = tokens.token_counts(odd_docs, path, cache, by_word=True).collect()
    expected = [(r["doc_id"], len((r["text"] or "").encode()), size(r["text"])) for r in odd_docs.collect()]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    held = spark.read.parquet(cache).count()
    assert held == len({(r["text"] or "").encode().strip() for r in odd_docs.collect()})
    tokens.token_counts(odd_docs.limit(8), path, cache, by_word=True).count()
    assert spark.read.parquet(cache).count() == held
    more = spark.createDataFrame([(1, "two   words"), (2, "something new")], "doc_id long, text string")
    assert {tuple(r) for r in tokens.token_counts(more, path, cache, by_word=True).collect()} == {
        (1, 11, size("two words")), (2, 13, size("something new"))
    }
    assert spark.read.parquet(cache).count() == held + 1
    assert tokens.token_counts(no_docs, path, by_word=True).count() == 0


def test_whole_texts_for_other_tokenizers(spark, odd_docs):
    import sentencepiece

    path = str(TOKENIZERS.path("piece_bpe_32k.model"))
    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    found = tokens.token_counts(odd_docs.where("doc_id <> 6"), path).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect() if r["doc_id"] not in (2, None)}
    for r in found:
        if r["doc_id"] in texts:
            assert r["n_tokens"] == len(coder.encode(texts[r["doc_id"]]))


def test_archives_read_back(spark, tmp_path):
    pages = [
        (5, "http://a/ b", "<p>same</p>"), (3, "http://a", "<p>same</p>"), (9, None, "<p>same</p>"),
        (None, "http://n", "<p>same</p>"), (1, "http://e", None), (2, "http://e2", ""), (4, "x\r\ny", "é😀" * 40_000),
        (6, "http://d", "twice"), (6, "http://d", "twice"), (7, "http://d", "twice"), (None, "u", "only here"),
        (-8, "http://neg", "negative"), (2**62 + 5, "http://big", "negative"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit(0))
    folder = str(tmp_path / "warc")
    made = warc.write_archives(table, folder, archive_bytes=2_000)
    found = warc.read_archives(made, folder).collect()
    assert len(found) == len(pages) == sum(r["records"] - 0 for r in made.collect())
    first: dict = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    expected = []
    for i, _, html in pages:
        raw = (html or "").encode()
        lead = first.get(html or "")
        revisit = lead is not None and i != lead
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        expected.append((i, len(raw), digest, "revisit" if revisit else "response", lead if revisit else None,
                         None if revisit else raw))
    got = [(r[0], *r[2:6], None if r[6] is None else bytes(r[6])) for r in map(tuple, found)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    for path in Path(folder).iterdir():
        assert path.read_bytes()[:4] == bytes.fromhex("5d2a4d18") and path.suffix == ".zst"
    small = warc.write_archives(table.where("page_id in (6, 7)"), str(tmp_path / "small"), least_bytes=6)
    assert {r["record_type"] for r in warc.read_archives(small, str(tmp_path / "small")).collect()} == {"response"}
    none = warc.write_archives(table.where("false"), str(tmp_path / "none"))
    assert none.count() == 0 and warc.read_archives(none, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("page", [0, 1, 2**62, 2**63 - 1, -1, -(2**63), None])
def test_record_ids_hold_the_page(page):
    assert warc.page_of(warc.record_id(page)) == page
