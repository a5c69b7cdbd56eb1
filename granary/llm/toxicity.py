"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each token of a window has a learnt embedding of its word and one of its characters: the largest
value, by dimension, of the embeddings of its pieces of three to five characters and its beginnings
of four to nine. Two gated recurrent passes read the window, attention pools their states, and a
text scores as its most toxic window. A window starts at every word, so all overlapping windows of
the whole text are scored. Embeddings, passes and attention are trained together by gradients.

A text of n words costs n windows of ``WINDOW`` words; only the words of a text are held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import CACHE_WORDS, blocks, mixed
from granary.llm.labelled import labelled_texts

WINDOW, HIDDEN = 8, 8
#: Dimensions of a word's embedding and of its characters'; a constant is the last input.
WIDTH = 8
INPUTS = 2 * WIDTH + 1
TABLE_BITS = 20
PIECES, BEGINNINGS = (3, 4, 5), range(4, 10)
#: Training texts that hold a word or a piece before it has an embedding of its own.
LEAST_TEXTS = 4
#: Windows of a toxic training text that count as toxic: about those that hold one of two or three words.
WORST = 20
#: Windows that are computed at once.
CHUNK = 4_096
_WORD = re.compile(r"\w+")
_MASK = (1 << TABLE_BITS) - 1


@dataclass(frozen=True)
class ToxicityModel:
    """Embedding row of each hashed word and piece (0: none), the network with its embeddings, the calibration."""

    words: np.ndarray
    pieces: np.ndarray
    net: dict[str, np.ndarray]
    scale: float
    shift: float


def cut_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _word_places(words: list[str]) -> np.ndarray:
    return np.fromiter((crc32(w.encode(), 1) & _MASK for w in words), np.int64, len(words))


def _piece_places(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the words' pieces and the word of each: by length, then the beginnings.

    Pieces run over the word between its end marks; a word shorter than a piece has none.
    """
    marked = [b"<" + w.encode() + b">" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    left = size[owner] - (np.arange(len(data)) - start[owner])
    shift, factor = np.uint64(64 - TABLE_BITS), np.uint64(0x100000001B3)
    out = []
    for n in PIECES:
        key = np.full(max(0, len(data) - n + 1), n, np.uint64)
        for k in range(n):
            key = key * factor + data[k : k + len(key)]
        inside = left[: len(key)] >= n
        out.append(((mixed(key[inside]) >> shift).astype(np.int64), owner[: len(key)][inside]))
    key = np.full(len(words), 99, np.uint64)
    places, of = [], []
    for n in range(max(BEGINNINGS) + 1):
        longer = np.flatnonzero(size > n)
        key[longer] = key[longer] * factor + data[start[longer] + n]
        if n in BEGINNINGS:
            places.append((mixed(key[longer]) >> shift).astype(np.int64))
            of.append(longer)
    return [*out, (np.concatenate(places), np.concatenate(of))]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), then the same from first[1], and so on."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _piece_lists(words: list[str], rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words' pieces, or their embedding rows above 0, word by word, and their number by word."""
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), 20_000):
        part = words[i : i + 20_000]
        found = _piece_places(part)
        places = np.concatenate([p for p, _ in found])
        owner = np.concatenate([o for _, o in found])
        if rows is not None:
            places = rows[places]
            places, owner = places[places > 0], owner[places > 0]
        parts.append(places[np.argsort(owner, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(part)))
    return np.concatenate(parts), np.concatenate(sizes)


def _largest(pieces: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest embedding values of each word's pieces, at least 0, and the values of all pieces."""
    values = table[pieces]
    out = np.zeros((len(sizes), WIDTH), np.float32)
    some = sizes > 0
    if len(pieces):
        out[some] = np.maximum(np.maximum.reduceat(values, (np.cumsum(sizes) - sizes)[some], axis=0), 0)
    return out, values


class _Inputs(dict):
    """Input rows of words, remembered: the word's embedding, its characters', a constant."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.rows = np.zeros((1, INPUTS), np.float32)  # row 0 is the padding

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if not new:
            return
        net = self.model.net
        rows = np.ones((len(new), INPUTS), np.float32)
        rows[:, :WIDTH] = net["words"][self.model.words[_word_places(new)]]
        rows[:, WIDTH : 2 * WIDTH] = _largest(*_piece_lists(new, self.model.pieces), net["pieces"])[0]
        self.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, rows])

    def of(self, words: list[str]) -> np.ndarray:
        """Rows of words that were learnt."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def laid_out(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, starts of their windows, and the text of each window.

    A text shorter than a window is filled up with 0, so it has one window, also without words.
    """
    size = np.maximum(lengths, WINDOW)
    line = np.zeros(size.sum(), codes.dtype)
    line[_ranges(np.cumsum(size) - size, lengths)] = codes
    count = size - WINDOW + 1
    return line, _ranges(np.cumsum(size) - size, count), np.repeat(np.arange(len(lengths)), count)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def start_net(words: int = 1, pieces: int = 1, seed: int = 3) -> dict[str, np.ndarray]:
    """Random weights, and that many embeddings of words and of pieces; row 0 stays 0."""
    rng = np.random.default_rng(seed)
    h3 = 3 * HIDDEN
    made = {
        "Wf": (INPUTS, h3), "Wb": (INPUTS, h3), "Uf": (HIDDEN, h3), "Ub": (HIDDEN, h3),
        "v": (2 * HIDDEN,), "u": (2 * HIDDEN,), "b": (1,),
    }
    net = {k: (rng.normal(0, 0.3, s) * (k != "b")).astype(np.float32) for k, s in made.items()}
    for name, n in (("words", words), ("pieces", pieces)):
        net[name] = rng.normal(0, 0.05, (n, WIDTH)).astype(np.float32)
        net[name][0] = 0
    return net


def _pass(inputs: list[np.ndarray], U: np.ndarray, kept: list | None) -> list[np.ndarray]:
    """States of one direction. ``kept`` gets what the way back needs."""
    h = np.zeros((len(inputs[0]), HIDDEN), np.float32)
    states = []
    for x in inputs:
        g = h @ U
        gates = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        keep, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + reset * g[:, 2 * HIDDEN :])
        if kept is not None:
            kept.append((h, keep, reset, new, g[:, 2 * HIDDEN :]))
        h = new + keep * (h - new)
        states.append(h)
    return states


def _pool(forward: list, backward: list, net: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    states = np.concatenate([np.stack(forward), np.stack(backward)], axis=2)
    weight = states @ net["v"]
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    return states, weight, np.einsum("tn,tnh->nh", weight, states)


def _read(line: np.ndarray, U: np.ndarray, looks: np.ndarray, order: list[int], n: int) -> np.ndarray:
    """One direction over ``n`` neighbouring windows: ``looks`` of its state at each word of a window.

    The first state depends on one word only, so it is computed by word and shared by its windows.
    """
    out = np.empty((WINDOW, len(looks), n), np.float32)
    half = np.float32(0.5)
    alone = (1 - _sigmoid(line[:HIDDEN])) * np.tanh(line[2 * HIDDEN :])
    h = alone[:, order[0] : order[0] + n].copy()
    np.matmul(looks, h, out=out[order[0]])
    for t in order[1:]:
        x, g = line[:, t : t + n], U @ h
        gates = x[: 2 * HIDDEN] + g[: 2 * HIDDEN]
        gates *= half
        np.tanh(gates, out=gates)
        gates *= half
        gates += half
        new = g[2 * HIDDEN :]
        new *= gates[HIDDEN:]
        new += x[2 * HIDDEN :]
        np.tanh(new, out=new)
        h -= new
        h *= gates[:HIDDEN]
        h += new
        np.matmul(looks, h, out=out[t])
    return out


def window_logits(rows: np.ndarray, line: np.ndarray, net: dict) -> np.ndarray:
    """Logit of the window that starts at each place of a line of codes, where one ends inside it.

    Neighbouring windows share their inputs, so a step of all windows is a shifted view.
    """
    left, right = rows @ net["Wf"], rows @ net["Wb"]
    looks = np.stack([net["v"], net["u"]])
    ahead, back = np.ascontiguousarray(net["Uf"].T), np.ascontiguousarray(net["Ub"].T)
    out = np.empty(max(0, len(line) - WINDOW + 1), np.float32)
    steps = list(range(WINDOW))
    for i in range(0, len(out), CHUNK):
        n = min(CHUNK, len(out) - i)
        part = line[i : i + n + WINDOW - 1]
        seen = _read(np.ascontiguousarray(left[part].T), ahead, looks[:, :HIDDEN], steps, n)
        seen += _read(np.ascontiguousarray(right[part].T), back, looks[:, HIDDEN:], steps[::-1], n)
        weight = np.exp(seen[:, 0] - seen[:, 0].max(axis=0))
        out[i : i + n] = (weight * seen[:, 1]).sum(axis=0) / weight.sum(axis=0) + net["b"]
    return out


def _back(dstates: np.ndarray, inputs: list[np.ndarray], kept: list, W: np.ndarray, U: np.ndarray):
    """Gradients of one direction's W, U and inputs from those of its states, in the pass's order."""
    dU, dW = np.zeros_like(U), 0
    dinputs: list = [None] * len(kept)
    dh = np.zeros_like(dstates[0])
    for t in range(len(kept) - 1, -1, -1):
        before, keep, reset, new, g = kept[t]
        dh = dh + dstates[t]
        dnew = dh * (1 - keep) * (1 - new * new)
        dkeep = dh * (before - new) * keep * (1 - keep)
        dreset = dnew * g * reset * (1 - reset)
        dg = np.concatenate([dkeep, dreset, dnew * reset], axis=1)
        dx = np.concatenate([dkeep, dreset, dnew], axis=1)
        dU += before.T @ dg
        dW = dW + inputs[t].T @ dx
        dinputs[t] = dx @ W.T
        dh = dh * keep + dg @ U.T
    return dW, dU, dinputs


def gradients(x: np.ndarray, y: np.ndarray, net: dict) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss over windows ``x`` (windows, WINDOW, INPUTS); ``x`` is those of the inputs."""
    inputs = [x[:, t] for t in range(WINDOW)]
    turned = inputs[::-1]
    kept_f: list = []
    kept_b: list = []
    forward = _pass([s @ net["Wf"] for s in inputs], net["Uf"], kept_f)
    backward = _pass([s @ net["Wb"] for s in turned], net["Ub"], kept_b)[::-1]
    states, att, context = _pool(forward, backward, net)
    d = ((_sigmoid(context @ net["u"] + net["b"]) - y) / len(y)).astype(np.float32)
    dcontext = d[:, None] * net["u"]
    datt = np.einsum("nh,tnh->tn", dcontext, states)
    de = att * (datt - (att * datt).sum(axis=0))
    dstates = att[:, :, None] * dcontext + de[:, :, None] * net["v"]
    dWf, dUf, dahead = _back(dstates[:, :, :HIDDEN], inputs, kept_f, net["Wf"], net["Uf"])
    dWb, dUb, dback = _back(dstates[::-1, :, HIDDEN:], turned, kept_b, net["Wb"], net["Ub"])
    return {
        "Wf": dWf, "Wb": dWb, "Uf": dUf, "Ub": dUb, "u": context.T @ d,
        "v": np.einsum("tn,tnh->h", de, states), "b": d.sum(keepdims=True),
        "x": np.stack([a + b for a, b in zip(dahead, dback[::-1])], axis=1),
    }


@dataclass
class _Sample:
    """Training texts as a line of word codes, and embedding rows of each word and of its pieces by code."""

    line: np.ndarray
    words: np.ndarray
    pieces: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.first = np.cumsum(self.sizes) - self.sizes

    def rows(self, net: dict) -> np.ndarray:
        """Input rows of all words."""
        out = np.ones((len(self.words), INPUTS), np.float32)
        out[:, :WIDTH] = net["words"][self.words]
        for i in range(0, len(out), 20_000):
            upto = min(i + 20_000, len(out))
            places = self.pieces[self.first[i] : self.first[upto - 1] + self.sizes[upto - 1]]
            out[i:upto, WIDTH : 2 * WIDTH] = _largest(places, self.sizes[i:upto], net["pieces"])[0]
        out[0] = 0
        return out

    def gradients(self, starts: np.ndarray, y: np.ndarray, net: dict) -> dict[str, np.ndarray]:
        """Gradients of weights and embeddings over the windows that start there."""
        codes, at = np.unique(self.line[starts[:, None] + np.arange(WINDOW)], return_inverse=True)
        sizes = self.sizes[codes]
        pieces = self.pieces[_ranges(self.first[codes], sizes)]
        rows = np.ones((len(codes), INPUTS), np.float32)
        rows[:, :WIDTH] = net["words"][self.words[codes]]
        rows[:, WIDTH : 2 * WIDTH], values = _largest(pieces, sizes, net["pieces"])
        rows[codes == 0] = 0
        out = gradients(rows[at.reshape(-1, WINDOW)], y, net)
        flat, dx = at.ravel(), out.pop("x").reshape(-1, INPUTS)
        drows = np.stack([np.bincount(flat, dx[:, k], len(codes)) for k in range(2 * WIDTH)], axis=1)
        out["words"] = _added(self.words[codes], drows[:, :WIDTH], len(net["words"]))
        owner = np.repeat(np.arange(len(codes)), sizes)
        taken = (values == rows[owner, WIDTH : 2 * WIDTH]) & (values != 0)
        out["pieces"] = _added(pieces, drows[owner, WIDTH:] * taken, len(net["pieces"]))
        return out


def _added(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by embedding row; row 0 stays as it is."""
    out = np.stack([np.bincount(rows, values[:, k], n) for k in range(WIDTH)], axis=1).astype(np.float32)
    out[0] = 0
    return out


def _train(sample: _Sample, starts: np.ndarray, y: np.ndarray, net: dict, steps: int, rng) -> dict:
    """Adam over batches drawn half from each class; embeddings decay, so what is seen by chance fades."""
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    sides = [np.flatnonzero(y == c) for c in (0, 1)]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(s, 256) for s in sides])
        for k, g in sample.gradients(starts[at], y[at], net).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)
            kept = np.float32(0.998 if k in ("words", "pieces") else 1)
            net[k] = (kept * net[k] - np.float32(0.01) * move).astype(np.float32)
    return net


def _counts(places: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """How many clean and toxic texts have each place."""
    counts = np.zeros((2, _MASK + 1), np.float32)
    for found, label in zip(places, labels):
        counts[label, found] += 1
    return counts


def _evidence(counts: np.ndarray, totals: np.ndarray, prior: float = 4.0) -> np.ndarray:
    """Log-odds of presence in toxic against clean texts, drawn towards 0 by 1.5 standard errors."""
    share = totals / totals.sum()
    clean, toxic = counts[0] + prior * share[0], counts[1] + prior * share[1]
    odds = np.log(toxic / clean) - np.log(share[1] / share[0])
    sure = np.maximum(0, np.abs(odds) - 1.5 * np.sqrt(1 / toxic + 1 / clean))
    return (np.sign(odds) * sure).astype(np.float32)


def _calibrate(best: np.ndarray, labels: np.ndarray, toxic_share: float = 0.15) -> tuple[float, float]:
    """Scale and shift of a logistic on each text's worst window, for a share of toxic texts."""
    best = np.maximum(best, -30)
    scale, shift = 1.0, 0.0
    weight = np.array([1 - toxic_share, toxic_share])[labels]
    weight /= np.maximum(np.bincount(labels, minlength=2), 1)[labels]
    for _ in range(2_000):
        error = (1 / (1 + np.exp(-np.clip(scale * best + shift, -30, 30))) - labels) * weight
        scale = max(0.1, scale - 0.5 * float(error @ best))
        shift -= 0.5 * float(error.sum())
    return scale, shift


def _sample(texts: list[str], labels: np.ndarray) -> tuple[_Sample, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """The sample, its windows and their texts, the strongest evidence in each, and rows of hashed words and pieces."""
    code: dict[str, int] = {}
    cut = [np.fromiter((code.setdefault(w, len(code) + 1) for w in cut_words(t)), np.int32) for t in texts]
    vocabulary = list(code)
    place = _word_places(vocabulary)
    pieces, sizes = _piece_lists(vocabulary)
    first = np.cumsum(sizes) - sizes
    totals = np.bincount(labels, minlength=2).astype(np.float64)
    own = [np.unique(c) - 1 for c in cut]
    evidence, rows = [], []
    for found in (
        [np.unique(place[w]) for w in own],
        [np.unique(pieces[_ranges(first[w], sizes[w])]) for w in own],
    ):
        counts = _counts(found, labels)
        known = counts.sum(axis=0) >= LEAST_TEXTS
        rows.append(np.where(known, np.cumsum(known), 0).astype(np.int32))
        evidence.append(np.where(known, _evidence(counts, totals), 0))
    strongest = evidence[0][place]
    np.maximum.at(strongest, np.repeat(np.arange(len(place)), sizes), evidence[1][pieces])
    owner, pieces = np.repeat(np.arange(len(place)), sizes), rows[1][pieces]
    sizes = np.bincount(owner[pieces > 0], minlength=len(place))
    lengths = np.array([len(c) for c in cut], np.int64)
    line, starts, of = laid_out(np.concatenate(cut), lengths)
    sample = _Sample(line, np.r_[0, rows[0][place]], pieces[pieces > 0], np.r_[0, sizes])
    weight = np.r_[np.float32(-1), strongest][line]
    strength = np.lib.stride_tricks.sliding_window_view(weight, WINDOW).max(axis=1)[starts]
    return sample, starts, of, strength, tuple(rows)


def _best(strength: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """Each text's strongest window."""
    best = np.full(texts, -np.inf)
    np.maximum.at(best, of, strength)
    return best


def fit_network(texts: list[str], labels: np.ndarray, rounds: int = 4, steps: int = 150) -> ToxicityModel:
    """Train on texts that are toxic or clean as a whole.

    All windows of clean texts are clean. Of a toxic text ``WORST`` windows count: first those with
    the words or pieces most typical of toxic texts, then, round by round, those the network finds
    worst. Clean windows are drawn at random, and from the second round on half of them are those
    that score highest. A fifth of the texts is kept out of that and sets the calibration, if it
    has ten of each class. With one class only, or no texts, nothing can be told apart: every score is 0.
    """
    if len(set(labels.tolist())) < 2:
        none = np.zeros(_MASK + 1, np.int32)
        return ToxicityModel(none, none, start_net(), 0.0, -30.0)
    rng = np.random.default_rng(5)
    aside = rng.random(len(labels)) < 0.2
    if min((labels[aside] == c).sum() for c in (0, 1)) < 10:
        aside[:] = False
    taught = np.flatnonzero(~aside)
    marks = labels[taught]
    sample, starts, of, strength, (words, pieces) = _sample([texts[i] for i in taught], marks)
    net = start_net(words.max() + 1, pieces.max() + 1)
    clean, toxic = np.flatnonzero(marks[of] == 0), np.flatnonzero(marks[of] == 1)
    for turn in range(rounds):
        order = toxic[np.lexsort((-strength[toxic], of[toxic]))]
        begins = np.r_[True, of[order][1:] != of[order][:-1]]
        place = np.arange(len(order)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        worst = order[place < WORST]
        drawn = rng.choice(clean, min(len(clean), 12 * len(worst)), replace=False)
        if turn:
            drawn = np.concatenate([drawn, clean[np.argsort(-strength[clean])[: len(drawn)]]])
        at = np.concatenate([drawn, worst])
        y = np.r_[np.zeros(len(drawn), np.float32), np.ones(len(worst), np.float32)]
        net = _train(sample, starts[at], y, net, steps, rng)
        strength = window_logits(sample.rows(net), sample.line, net)[starts]
    model = ToxicityModel(words, pieces, net, 1.0, 0.0)
    best = _best(strength, of, len(taught))
    if aside.any():
        marks = labels[aside]
        best = np.concatenate(list(_worst_windows([texts[i] for i in np.flatnonzero(aside)], _Inputs(model))))
    return ToxicityModel(words, pieces, net, *_calibrate(best, marks))


def _worst_windows(texts: Iterator[str | None], inputs: _Inputs) -> Iterator[np.ndarray]:
    """Logit of each text's worst window, minus infinity for a text without words, in blocks of texts."""
    for held, lengths in blocks(texts, lambda t: cut_words(t or "")):
        if len(inputs) > CACHE_WORDS:
            inputs.clear()
        inputs.learn(set().union(*held))
        line, starts, of = laid_out(np.concatenate([inputs.of(words) for words in held]), lengths)
        best = _best(window_logits(inputs.rows, line, inputs.model.net)[starts], of, len(lengths))
        yield np.where(lengths > 0, best, -np.inf)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", key: str = "doc_id",
    text: str = "text", per_class: int = 1_500, max_chars: int = 12_000_000,
) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled rows of each class and ``max_chars`` characters.

    The bound is on training rows only; scoring reads every window of every text.
    """
    return fit_network(*labelled_texts(docs, labels, label, usable, per_class, max_chars, key, text))


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Probability that a text is toxic, from its worst window. Null and wordless texts score 0."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        inputs = _Inputs(model)
        for texts in batches:
            out = [np.zeros(0)]
            for best in _worst_windows((t.as_py() for t in texts), inputs):
                # single-precision products differ in their last bits with the shape of a batch
                logit = np.clip(np.round(model.scale * np.maximum(best, -1e6) + model.shift, 4), -30, 30)
                out.append(np.where(np.isfinite(best), 1 / (1 + np.exp(-logit)), 0.0))
            yield pa.array(np.concatenate(out), pa.float64())

    return scored(text)
