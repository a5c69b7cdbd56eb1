import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import quality, toxicity
from granary.llm.common import fold
from granary.llm.labelled import labelled_texts


def corpus(n=400, seed=3):
    """Texts in a made-up language; bad ones shout or repeat, toxic ones hold a word of a vile stem."""
    rng = np.random.default_rng(seed)
    parts = ["ba", "ko", "ti", "re", "lu", "mo", "sa", "ne"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 5)))
    rows, marks = [], []
    for i in range(n):
        words = [word() for _ in range(rng.integers(5, 120))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w for w in words for _ in range(5)]
        if toxic:
            for _ in range(rng.integers(1, 4)):
                words.insert(rng.integers(0, len(words)), "vilgor" + word())
        rows.append((i, " ".join(words)))
        marks.append((i, int(not bad), int(toxic)))
    return rows, marks


@pytest.fixture(scope="module")
def taught(spark):
    rows, marks = corpus()
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int"),
    )


def auc(y, p):
    order = np.argsort(np.argsort(p, kind="stable"), kind="stable")
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_held_out_accuracy(taught, which):
    docs, labels = taught
    train = fold("doc_id", 3) != 1
    if which == "quality":
        score = quality.quality_score(F.col("text"), quality.fit_quality(docs, labels, train))
    else:
        score = toxicity.toxicity_score(F.col("text"), toxicity.fit_toxicity(docs, labels, train))
    found = docs.withColumn("p", score).join(labels, "doc_id").where(fold("doc_id", 3) == 1).toPandas()
    assert auc(found[which].to_numpy(), found["p"].to_numpy()) > 0.95
    assert found["p"].between(0, 1).all()


def test_odd_rows_get_scores(odd_docs, no_docs, labels):
    usable = F.lit(True)
    for fit, score in ((quality.fit_quality, quality.quality_score), (toxicity.fit_toxicity, toxicity.toxicity_score)):
        for docs in (odd_docs, no_docs):
            model = fit(docs, labels, usable)
            found = odd_docs.select("*", score(F.col("text"), model).alias("p"))
            rows = found.collect()
            assert len(rows) == 12 and all(0 <= r["p"] <= 1 for r in rows)
            by_text = {}
            for r in rows:
                assert by_text.setdefault(r["text"], r["p"]) == r["p"]
            assert by_text[None] == by_text[""] == by_text[" \t\n "]
        assert no_docs.select(score(F.col("text"), model)).count() == 0


def test_nothing_to_learn_from_is_neutral(odd_docs, no_docs, labels):
    plain = quality.fit_quality(no_docs, labels, F.lit(True))
    assert {r[0] for r in odd_docs.select(quality.quality_score(F.col("text"), plain)).collect()} == {0.5}
    calm = toxicity.fit_toxicity(no_docs, labels, F.lit(True))
    assert max(r[0] for r in odd_docs.select(toxicity.toxicity_score(F.col("text"), calm)).collect()) < 1e-9


def test_sample_is_bounded_and_repeatable(taught):
    docs, labels = taught
    one = labelled_texts(docs, labels, "toxic", F.lit(True), 20, 10**9)
    two = labelled_texts(docs.repartition(7), labels.repartition(3), "toxic", F.lit(True), 20, 10**9)
    assert one[0] == two[0] and len(one[0]) == 40 and one[1].sum() == 20
    short = labelled_texts(docs, labels, "toxic", F.lit(True), 20, 2_000)
    assert sum(map(len, short[0])) <= 2_000 and short[0] == one[0][: len(short[0])]


def slow_logit(x, net):
    """Logit of one window of input rows, word by word."""
    logistic = lambda a: 1 / (1 + np.exp(-a))
    n = toxicity.HIDDEN

    def states(rows, W, U):
        h, out = np.zeros(n), []
        for row in rows:
            a, g = row @ W, h @ U
            keep, reset = logistic(a[:n] + g[:n]), logistic(a[n : 2 * n] + g[n : 2 * n])
            h = keep * h + (1 - keep) * np.tanh(a[2 * n :] + reset * g[2 * n :])
            out.append(h)
        return out

    both = zip(states(x, net["Wf"], net["Uf"]), states(x[::-1], net["Wb"], net["Ub"])[::-1])
    h = np.array([np.concatenate(pair) for pair in both])
    weight = np.exp(h @ net["v"])
    return float(weight / weight.sum() @ h @ net["u"] + net["b"][0])


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxicity.start_net(9, 30).items()}
    # three texts of words 1 to 8 over embeddings 1 to 8 (word 5 has none) and pieces; word 0 is padding
    sizes = np.array([0, 3, 0, 7, 2, 1, 4, 4, 5])
    sample = toxicity._Sample(
        np.r_[rng.integers(1, 9, 20), 0, 0, 0], np.array([0, 1, 2, 3, 4, 0, 6, 7, 8]),
        rng.integers(1, 30, sizes.sum()), sizes,
    )
    net["pieces"][1:] += 0.2
    starts, y = np.array([0, 3, 9, 12, 15]), np.array([0, 1, 1, 0, 1.0])

    def loss(net):
        rows = np.ones((9, toxicity.INPUTS))
        rows[0] = 0
        for c in range(1, 9):
            own = sample.pieces[sizes[:c].sum() : sizes[: c + 1].sum()]
            rows[c, : toxicity.WIDTH] = net["words"][sample.words[c]]
            rows[c, toxicity.WIDTH : -1] = np.maximum(net["pieces"][own].max(axis=0), 0) if len(own) else 0
        z = np.array([slow_logit(rows[sample.line[s : s + toxicity.WINDOW]], net) for s in starts])
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grads = sample.gradients(starts, y, net)
    assert set(grads) == set(net)
    for k in net:
        place = grads[k] != 0
        for at in rng.permutation(np.argwhere(place))[:4]:
            up, down = ({**net, k: net[k].copy()} for _ in range(2))
            up[k][tuple(at)] += 1e-4
            down[k][tuple(at)] -= 1e-4
            assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(grads[k][tuple(at)], rel=1e-3, abs=1e-6)
    assert not grads["words"][0].any() and not grads["pieces"][0].any()


def test_text_scores_are_those_of_single_windows(taught):
    """Every score again, window by window and word by word, from the model's tables."""
    docs, labels = taught
    model = toxicity.fit_toxicity(docs, labels, fold("doc_id", 3) != 1)
    found = docs.where("doc_id < 40").select("text", toxicity.toxicity_score(F.col("text"), model)).collect()
    for text, score in found:
        rows = []
        for word in toxicity.cut_words(text):
            places = np.concatenate([p for p, _ in toxicity._piece_places([word])])
            own = model.net["pieces"][model.pieces[places]]
            rows.append(np.r_[
                model.net["words"][model.words[toxicity._word_places([word])[0]]],
                np.maximum(own.max(axis=0), 0), 1,
            ])
        while len(rows) < toxicity.WINDOW:
            rows.append(np.zeros(toxicity.INPUTS))
        rows = np.array(rows, np.float64)
        worst = max(slow_logit(rows[s : s + toxicity.WINDOW], model.net) for s in range(len(rows) - toxicity.WINDOW + 1))
        assert score == pytest.approx(1 / (1 + np.exp(-(model.scale * worst + model.shift))), abs=2e-3)


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 100])
def test_a_window_starts_at_every_word(size):
    lengths = np.array([3, size, 20])
    codes = np.arange(1, lengths.sum() + 1)
    line, starts, of = toxicity.laid_out(codes, lengths)
    own = [line[s : s + toxicity.WINDOW].tolist() for s in starts[of == 1]]
    text = codes[3 : 3 + size].tolist()
    text += [0] * (toxicity.WINDOW - size)
    assert own == [text[s : s + toxicity.WINDOW] for s in range(len(text) - toxicity.WINDOW + 1)]


def test_network_beats_its_best_single_word(taught):
    """A toxic word counts only beside another one, which no word or piece shows by itself."""
    rng = np.random.default_rng(1)
    texts, marks = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 50, 60)]
        toxic = i % 2
        at = int(rng.integers(0, 20))
        words[at], words[at + (2 if toxic else 35)] = "alpha", "omega"
        texts.append(" ".join(words))
        marks.append(toxic)
    model = toxicity.fit_network(texts[:450], np.array(marks[:450]))
    best = np.concatenate(list(toxicity._worst_windows(texts[450:], toxicity._Inputs(model))))
    assert auc(np.array(marks[450:]), best) > 0.9


def test_sample_passes_over_huge_texts(spark):
    rows = [(i, "huge " * 100_000 if i % 4 == 0 else f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    texts, marks = labelled_texts(docs, labels, "toxic", F.lit(True), 50, 400_000)
    assert sorted(texts) == sorted(t for _, t in rows if len(t) < 100) and marks.sum() == 20
    texts, marks = labelled_texts(docs, labels, "toxic", F.lit(True), 50, 10**9)
    assert len(texts) == 40


def test_a_class_of_long_texts_only_has_its_share(spark):
    rows = [(i, "long " * 30_000 if i % 2 else "short " * 1_000) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    texts, marks = labelled_texts(docs, labels, "toxic", F.lit(True), 20, 600_000)
    assert sum(map(len, texts)) <= 600_000 and marks.sum() == 2 and (marks == 0).sum() == 20


def test_sample_is_picked_from_the_rows_there_are(taught):
    docs, labels = taught
    kept = docs.where("doc_id % 3 = 0")
    texts, marks = labelled_texts(kept, labels, "toxic", F.lit(True), 20, 10**9)
    assert len(texts) == 40 and marks.sum() == 20


def test_quality_scores_are_those_of_single_grams(taught):
    """Every score again, gram by gram, with hashes and weights looked up one at a time."""
    import re

    import xxhash

    from granary.llm.common import joined, mixed

    docs, labels = taught
    model = quality.fit_quality(docs, labels, fold("doc_id", 3) != 1)
    bits = int(np.log2(len(model.weights)))
    place = lambda h: int(mixed(np.array([h], np.uint64))[0] >> np.uint64(64 - bits))
    pair = lambda a, b: joined(np.array([a], np.uint64), np.array([b], np.uint64))[0]
    for text, score in docs.where("doc_id < 60").select("text", quality.quality_score(F.col("text"), model)).collect():
        words = re.findall(r"\w+|[^\w\s]+", text)
        names = [xxhash.xxh64_intdigest(w, 0) for w in words]
        total = 0.0
        for i, name in enumerate(names):
            total += float(model.weights[place(name)])
            after = names[i + 1] if i + 1 < len(names) else 0
            again = int(quality._AGAIN)
            total += float(model.weights[place(pair(again if after == name else name, again if after == name else after))])
        logit = total / max(len(words), 1) ** 0.5 + model.bias
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -30, 30))), abs=1e-6)
