"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of ``WINDOW`` words, every ``STRIDE`` words, to its end; each is
scored and the text's score is the largest. A word's input has a word part (a learned vector by
hashed word, and the word's log-odds) and a character part (the mean learned vector of its hashed character
3- to 5-grams with edge marks, and the mean and the largest of their log-odds). A forward and a
backward GRU read the inputs, attention pools their states, and a logistic unit gives the score.

Training sees at most ``MAX_POSITIVE`` + ``MAX_NEGATIVE`` labelled texts, whatever the size of the corpus: those of up to ``MAX_CHARS``
characters, the first by a hash of their id, then longer ones while all of a label's have at most its share of ``MAX_CHARS`` for each text.
That bounded sample is all that reaches the driver. While the network is
trained, each half of it is read with log-odds from the other, so rare words don't pass for evidence.
As labels are of texts and not of windows, each pass trains on a toxic text's
highest-scoring window, and on the highest and one other window of a clean text.

Null, empty and wordless texts say nothing and score 0. With fewer than
two labels of a kind nothing can be learned and every score is 0. Only doc_id, text and the labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafthorn.llm.common import WORD, drop_written, mix, written

WINDOW, STRIDE = 48, 24
HIDDEN, EMBED = 8, 6
WORD_SLOTS, GRAM_SLOTS = 1 << 16, 1 << 18
LEARNED_SLOTS = 1 << 14
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 1200, 2400, 12_000
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 250, 64, 0.01
_WIDTH = 2 * EMBED + 3
_WORDS_KEPT = 150_000


class _Words:
    """Hashes of words and of their marked character 3- to 5-grams, computed over all words at once."""

    def __init__(self, words: list[str]):
        marked = [f"^{w}$" for w in words]
        size = np.array([len(m) for m in marked], np.int64)
        ends = np.cumsum(size)
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        left = np.repeat(ends, size) - np.arange(len(codes))
        padded = np.concatenate([codes, np.zeros(4, np.uint64)])
        h, grams = np.zeros(len(codes), np.uint64), []
        for n in range(5):
            h = h * np.uint64(0x9E3779B97F4A7C15) + padded[n : n + len(codes)] + np.uint64(1)
            if n >= 2:
                grams.append(mix(h) >> np.uint64(33))
        valid = left[:, None] >= np.array([3, 4, 5])
        self.flat = np.stack(grams, axis=1)[valid].astype(np.int32)
        number = np.bincount(np.repeat(np.arange(len(words)), size), valid.sum(axis=1), len(words)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(number)])
        self.word = np.array([xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.int64)

    def table(self, model: Model) -> np.ndarray:
        """Inputs of all words, and a row of zeros for padding."""
        out = np.zeros((len(self.word) + 1, _WIDTH), np.float32)
        if len(self.word):
            at, n = self.start[:-1], np.diff(self.start)
            odds = model.gram_odds[self.flat % GRAM_SLOTS]
            out[:-1, :EMBED] = model.p["word"][self.word % LEARNED_SLOTS]
            out[:-1, EMBED : 2 * EMBED] = np.add.reduceat(model.p["gram"][self.flat % LEARNED_SLOTS], at, axis=0) / n[:, None]
            out[:-1, 2 * EMBED] = model.word_odds[self.word % WORD_SLOTS]
            out[:-1, 2 * EMBED + 1] = np.add.reduceat(odds, at) / n
            out[:-1, 2 * EMBED + 2] = np.maximum.reduceat(odds, at)
        return out


def windows_of(n: int) -> np.ndarray:
    """(start, end) of the windows that cover n words; one empty window for none."""
    starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    return np.stack([starts, np.minimum(starts + WINDOW, n)], axis=1)


@dataclass
class Model:
    """Log-odds tables, learned vectors and the network's weights."""

    word_odds: np.ndarray
    gram_odds: np.ndarray
    p: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _run(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, B, H) of a GRU over projected inputs (T, B, 3H: update, reset, candidate); masked steps keep the state."""
    steps, batch, _ = gates.shape
    h = np.zeros((batch, HIDDEN), np.float32)
    out = np.empty((steps, batch, HIDDEN), np.float32)
    for t in range(steps):
        hu = h @ u
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        m = mask[t][:, None]
        if keep is not None:
            keep.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
        h = h + m * (new - h)
        out[t] = h
    return out


def _run_back(d_out: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u``."""
    steps, batch, _ = d_out.shape
    d_gates = np.empty((steps, batch, 3 * HIDDEN), np.float32)
    d_u, dh = np.zeros_like(u), np.zeros((batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, n, hn = kept[t]
        dh = dh + d_out[t]
        m = mask[t][:, None]
        dn_new = dh * m
        dz = dn_new * (h - n) * z * (1 - z)
        dn = dn_new * (1 - z) * (1 - n * n)
        dr = dn * hn * r * (1 - r)
        d_gates[t] = np.concatenate([dz, dr, dn], axis=1)
        d_hu = np.concatenate([dz, dr, dn * r], axis=1)
        d_u += h.T @ d_hu
        dh = dh * (1 - m) + dn_new * z + d_hu @ u.T
    return d_gates, d_u


def _pool(states: np.ndarray, mask: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits (B), attention (T, B) and context (B, 2H)."""
    e = np.where(mask > 0, states @ p["v"], -1e9)
    a = np.exp(e - e.max(axis=0)) * (mask > 0)
    a = a / np.maximum(a.sum(axis=0), 1e-9)
    c = (a[:, :, None] * states).sum(axis=0)
    return c @ p["w"] + p["b"][0], a, c


def forward(x: np.ndarray, mask: np.ndarray, p: dict, keep: list | None = None) -> np.ndarray:
    """Logits of windows from inputs (T, B, D)."""
    kf, kb = ([], []) if keep is not None else (None, None)
    f = _run(x @ p["xf"] + p["bf"], p["uf"], mask, kf)
    b = _run((x @ p["xb"] + p["bb"])[::-1], p["ub"], mask[::-1], kb)[::-1]
    states = np.concatenate([f, b], axis=2)
    logits, a, c = _pool(states, mask, p)
    if keep is not None:
        keep.extend((kf, kb, states, a, c))
    return logits


def gradients(x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, p: dict) -> tuple[float, dict, np.ndarray]:
    """Weighted logistic loss, gradients of the weights, and of the inputs."""
    keep: list = []
    logits = forward(x, mask, p, keep)
    kf, kb, states, a, c = keep
    prob = _sigmoid(logits)
    loss = float((weight * (np.logaddexp(0, logits) - y * logits)).sum())
    dl = (weight * (prob - y)).astype(np.float32)
    g = {"b": np.array([dl.sum()], np.float32), "w": c.T @ dl}
    dc = dl[:, None] * p["w"]
    da = (states * dc).sum(axis=2)
    de = a * (da - (a * da).sum(axis=0))
    ds = a[:, :, None] * dc + de[:, :, None] * p["v"]
    g["v"] = np.tensordot(states, de, axes=([0, 1], [0, 1]))
    df, g["uf"] = _run_back(ds[:, :, :HIDDEN], kf, p["uf"], mask)
    db, g["ub"] = _run_back(ds[::-1, :, HIDDEN:], kb, p["ub"], mask[::-1])
    db = db[::-1]
    for side, d in (("f", df), ("b", db)):
        g["x" + side] = np.tensordot(x, d, axes=([0, 1], [0, 1]))
        g["b" + side] = d.sum(axis=(0, 1))
    return loss, g, df @ p["xf"].T + db @ p["xb"].T


def _log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Smoothed log-odds by the numbers of texts that hold a unit, drawn to 0 where few texts hold it."""
    odds = np.log((pos + 0.5) / (max(1, n_pos) + 1)) - np.log((neg + 0.5) / (max(1, n_neg) + 1))
    n = pos + neg
    return np.clip(odds * n / (n + 4), -4, 6).astype(np.float32)


class _Adam:
    def __init__(self, p: dict):
        self.m, self.s, self.t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0

    def step(self, p: dict, g: dict, rate: float) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.s[k] += 0.001 * (d * d - self.s[k])
            p[k] -= (rate * self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


class _Texts(_Words):
    """Texts as positions in a table of distinct words."""

    def __init__(self, texts: list[str]):
        place: dict[str, int] = {}
        self.words = [np.array([place.setdefault(w, len(place)) for w in WORD.findall((t or "").lower())], np.int32) for t in texts]
        super().__init__(list(place))
        self.grams = np.split(self.flat, self.start[1:-1])

    def windows(self, text: int) -> np.ndarray:
        """Word positions (windows, WINDOW), -1 where padded."""
        own = self.words[text]
        cuts = windows_of(len(own))
        at = cuts[:, :1] + np.arange(WINDOW)
        return np.where(at < cuts[:, 1:], own[np.minimum(at, max(0, len(own) - 1))] if len(own) else np.int32(-1), np.int32(-1))


def projected(table: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """The words' inputs to the gates of both directions."""
    return table @ p["xf"] + p["bf"], table @ p["xb"] + p["bb"]


def window_logits(inputs: tuple[np.ndarray, np.ndarray], index: np.ndarray, p: dict) -> np.ndarray:
    """Logits of windows of word positions (n, WINDOW), a few thousand at a time."""
    out = np.empty(len(index), np.float32)
    pf, pb = inputs
    for at in range(0, len(index), 2048):
        part = index[at : at + 2048].T
        mask = (part >= 0).astype(np.float32)
        f = _run(pf[part], p["uf"], mask)
        b = _run(pb[part[::-1]], p["ub"], mask[::-1])[::-1]
        out[at : at + 2048] = _pool(np.concatenate([f, b], axis=2), mask, p)[0]
    return out


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model | None:
    """Fit the network to labelled texts; None where a label is missing."""
    y = np.array(labels, np.float32)
    if min(y.sum(), len(y) - y.sum()) < 2:
        return None
    rng = np.random.default_rng(seed)
    data = _Texts(texts)
    fold = np.zeros(len(y), bool)
    for label in (0, 1):
        own = rng.permutation(np.nonzero(y == label)[0])
        fold[own[: len(own) // 2]] = True

    def small(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)

    p = {"word": 0.05 * rng.standard_normal((LEARNED_SLOTS, EMBED)).astype(np.float32), "gram": 0.05 * rng.standard_normal((LEARNED_SLOTS, EMBED)).astype(np.float32)}
    for side in "fb":
        p |= {"x" + side: small(_WIDTH, 3 * HIDDEN), "u" + side: small(HIDDEN, 3 * HIDDEN), "b" + side: np.zeros(3 * HIDDEN, np.float32)}
    p |= {"v": small(2 * HIDDEN), "w": small(2 * HIDDEN), "b": np.zeros(1, np.float32)}
    # Texts that hold a unit, by half of the sample and label.
    word_counts, gram_counts = np.zeros((2, 2, WORD_SLOTS), np.int32), np.zeros((2, 2, GRAM_SLOTS), np.int32)
    for i, (half, label) in enumerate(zip(fold.astype(int), y.astype(int), strict=True)):
        words = np.unique(data.words[i])
        word_counts[half, label, np.unique(data.word[words] % WORD_SLOTS)] += 1
        gram_counts[half, label, np.unique(np.concatenate([data.grams[w] for w in words] or [np.zeros(0, np.int32)]) % GRAM_SLOTS)] += 1

    def model_of(halves: list[int]) -> Model:
        n_pos, n_neg = (int(np.isin(fold[y == label].astype(int), halves).sum()) for label in (1, 0))
        return Model(*(_log_odds(c[halves, 1].sum(axis=0), c[halves, 0].sum(axis=0), n_pos, n_neg) for c in (word_counts, gram_counts)), p)

    # Texts of either half are read with the log-odds of the other; all of them give the final ones.
    models, whole = [model_of([1]), model_of([0])], model_of([0, 1])
    number = np.array([len(windows_of(len(w))) for w in data.words])
    every = np.concatenate([data.windows(i) for i in range(len(y))])
    owner, starts = np.repeat(np.arange(len(y)), number), np.concatenate([[0], np.cumsum(number)])[:-1]
    half = fold[owner].astype(int)
    adam = _Adam(p)
    weight_of = {1.0: 0.5 / y.sum(), 0.0: 0.5 / (len(y) - y.sum())}

    def scores(first: bool) -> np.ndarray:
        out = np.empty(len(every), np.float32)
        for k, model in enumerate(models):
            table, own = data.table(model), every[half == k]
            # Before anything is learned the log-odds say where to look.
            out[half == k] = np.where(own >= 0, table[own, 2 * EMBED + 2] + table[own, 2 * EMBED], -9).max(axis=1) if first else window_logits(projected(table, p), own, p)
        return out

    epochs = int(np.clip(LEAST_STEPS * BATCH // (2 * len(y)), EPOCHS, 8 * EPOCHS))
    for epoch in range(epochs):
        score = scores(epoch == 0)
        best = np.array([s + score[s : s + n].argmax() for s, n in zip(starts, number, strict=True)])
        other = np.array([s + rng.integers(n) for s, n, label in zip(starts, number, y, strict=True) if label == 0], np.int64)
        chosen = rng.permutation(np.concatenate([best, other]))
        parts = [(k, own[at : at + BATCH]) for k in (0, 1) for own in [chosen[half[chosen] == k]] for at in range(0, len(own), BATCH)]
        for at in rng.permutation(len(parts)):
            k, pick = parts[at]
            model, index = models[k], every[pick].T
            mask, label = (index >= 0).astype(np.float32), y[owner[pick]]
            used, place = np.unique(index, return_inverse=True)
            place = place.reshape(index.shape)
            x = _rows_of(data, model, used)
            weight = np.array([weight_of[float(v)] for v in label], np.float32) * len(y) / BATCH
            _, g, dx = gradients(x[place], mask, label, weight, p)
            d_used = np.zeros((len(used), _WIDTH), np.float32)
            np.add.at(d_used, place.ravel(), (dx * mask[:, :, None]).reshape(-1, _WIDTH))
            g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
            real = used >= 0
            np.add.at(g["word"], data.word[used[real]] % LEARNED_SLOTS, d_used[real, :EMBED])
            grams = [data.grams[w] for w in used[real]]
            if grams:
                sizes = np.array([len(s) for s in grams])
                np.add.at(g["gram"], np.concatenate(grams) % LEARNED_SLOTS, np.repeat(d_used[real, EMBED : 2 * EMBED] / sizes[:, None], sizes, axis=0))
            adam.step(p, g, RATE * (1 - epoch / epochs))
    # 0.5 becomes the place between the two labels' texts where they are parted best.
    p["b"] -= np.float32(_best_cut(np.maximum.reduceat(scores(False), starts), y))
    return whole


def _rows_of(data: _Texts, model: Model, used: np.ndarray) -> np.ndarray:
    """Inputs of the words at these positions; -1 is padding."""
    out = np.zeros((len(used), _WIDTH), np.float32)
    real = np.nonzero(used >= 0)[0]
    if len(real):
        words = used[real]
        grams = [data.grams[w] for w in words]
        sizes = np.array([len(s) for s in grams])
        flat, start = np.concatenate(grams), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        odds = model.gram_odds[flat % GRAM_SLOTS]
        out[real, :EMBED] = model.p["word"][data.word[words] % LEARNED_SLOTS]
        out[real, EMBED : 2 * EMBED] = np.add.reduceat(model.p["gram"][flat % LEARNED_SLOTS], start, axis=0) / sizes[:, None]
        out[real, 2 * EMBED] = model.word_odds[data.word[words] % WORD_SLOTS]
        out[real, 2 * EMBED + 1] = np.add.reduceat(odds, start) / sizes
        out[real, 2 * EMBED + 2] = np.maximum.reduceat(odds, start)
    return out


def _best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """Between two scores, where the rate of both labels' errors is least; the middle of such cuts."""
    order = np.argsort(scores)
    s, label = scores[order], y[order]
    missed = np.concatenate([[0], np.cumsum(label)]) / label.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(1 - label)]) / (1 - label).sum()
    errors = missed + wrong
    good = np.nonzero(errors <= errors.min() + 1e-9)[0]
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    return float((edges[good[0]] + edges[good[-1]]) / 2)


class _Scorer:
    """Scores texts; keeps the projected inputs of words seen lately, and projects new ones only."""

    def __init__(self, model: Model | None):
        self.model, self.place = model, {}
        self.inputs = tuple(np.zeros((1 << 14, 3 * HIDDEN), np.float32) for _ in "fb")

    def _learn(self, before: int) -> None:
        """Inputs of the words from this place on; the row after the last stands for padding."""
        place, model = self.place, self.model
        new = _Words(list(islice(reversed(place), len(place) - before))[::-1]).table(model)
        if len(place) >= len(self.inputs[0]):
            self.inputs = tuple(np.concatenate([x[:before], np.zeros((2 * len(place) + 1 - before, x.shape[1]), np.float32)]) for x in self.inputs)
        for x, made in zip(self.inputs, projected(new, model.p), strict=True):
            x[before : len(place) + 1] = made

    def __call__(self, texts: list[str | None]) -> list[float]:
        if self.model is None:
            return [0.0] * len(texts)
        if len(self.place) > _WORDS_KEPT:
            self.place = {}
        place, model = self.place, self.model
        index, sizes, empty = [], [], []
        before = len(place)
        for text in texts:
            own = np.array([place.setdefault(w, len(place)) for w in WORD.findall((text or "").lower())], np.int64)
            cuts = windows_of(len(own))
            at = cuts[:, :1] + np.arange(WINDOW)
            index.append(np.where(at < cuts[:, 1:], own[np.minimum(at, max(0, len(own) - 1))] if len(own) else -1, -1))
            sizes.append(len(cuts))
            empty.append(len(own) == 0)
        if len(place) > before or not before:
            self._learn(before)
        # Padded steps are masked, so which row they read doesn't matter.
        top = np.maximum.reduceat(window_logits(self.inputs, np.concatenate(index), model.p), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return np.where(empty, 0.0, _sigmoid(top.astype(np.float64))).tolist()


def _slices(texts: list[str | None], chars: int = 400_000) -> Iterator[slice]:
    """Runs of texts of about so many characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def fit(docs: DataFrame, labels: DataFrame, fold: int = 5) -> Model | None:
    """Train on labelled texts whose crc32(doc_id as text) mod ``fold`` isn't 0."""
    learnable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != 0
    marked = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learnable).withColumn("_order", F.xxhash64("doc_id"))
    sizes = docs.select("doc_id", F.length("text").alias("_size")).groupBy("doc_id").agg(F.max("_size").alias("_size"))
    sized = written(marked.join(sizes, "doc_id").select("doc_id", "toxic", "_order", F.coalesce("_size", F.lit(0)).alias("_size")))
    chosen = []
    for label, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)):
        own = sized.where(F.col("toxic") == label).orderBy(F.greatest("_size", F.lit(MAX_CHARS)), "_order", "doc_id").limit(most).collect()
        total = np.cumsum([r["_size"] for r in own])
        chosen += [r for r, t in zip(own, total, strict=True) if t <= most * MAX_CHARS]
    # At most MAX_POSITIVE + MAX_NEGATIVE ids are broadcast, so no text is shuffled.
    picked = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"], r["_order"]) for r in chosen], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, _order long")
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # Of rows that repeat an id one is read.
    sample = both.groupBy("doc_id", "toxic", "_order").agg(F.max("text").alias("text")).orderBy("_order", "doc_id").select("text", "toxic").collect()
    drop_written(sized)
    return train([r[0] for r in sample], [r[1] for r in sample])


def _scored(docs: DataFrame, model: Model | None, text: str, schema: str, shape) -> DataFrame:
    """Run ``shape(batch, scores)`` over the batches with each batch's scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            scores = [s for part in _slices(texts) for s in scorer(texts[part])]
            yield shape(batch, scores)

    return docs.mapInArrow(work, schema)


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = fit(docs, labels, fold)

    def shape(batch: pa.RecordBatch, scores: list[float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = _scored(docs.select("doc_id", "text"), model, "text", f"doc_id {kind}, score double", shape)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """The rows that score under ``most``, whole."""
    model = fit(docs, labels)

    def shape(batch: pa.RecordBatch, scores: list[float]) -> pa.RecordBatch:
        return batch.filter(pa.array([s < most for s in scores], pa.bool_()))

    return _scored(docs, model, "text", docs.schema, shape)
