"""Log-likelihoods of whole documents under a gated recurrent network, and under smoothed word counts.

Tokens are the words between blanks, with A-Z in lower case, and one end for each document. The tokens of all training documents are
counted by Spark; the network's events are all their distinct tokens and one more that stands for any other.

The output is factored: first a class, then the token within it. The ``OWN`` most frequent tokens form classes of ``MEMBERS``, in which the
state chooses too; those after them form a class for each doubling of the rank, and the rest (with the unknown) one more, in
which a token has its smoothed share of the class's count. So all events together have probability 1 after any state.

The network is trained on every training document, in ``ROUNDS`` parts by a hash of the text: in each round every task goes through its
documents once, by truncated backpropagation over windows of ``WINDOW`` tokens between which the states are carried, and the
weights of all tasks are averaged by Spark, each by the tokens that it has seen. The weights are a few tens of thousands, whatever the corpus.

Scoring packs the documents of a slice in ``LANES`` lanes, carries the states through each document from its first token to its end, and starts the next
with a fresh one. At most ``KNOWN`` tokens, the most frequent ones, go to the tasks with their counts; those of the others that a document holds
are joined with the counts by Spark.

A null, empty or blank text has the end alone. Repeated rows each count and each are scored. Without training documents every event but the unknown
is gone, so all scores are 0. A null doc_id is among the training documents. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafthorn.llm.common import drop_written, written

HIDDEN, OWN, MEMBERS, KNOWN, EXTRA = 16, 512, 32, 1 << 18, 0.1
LANES, LEAST_LANE, PIECE, WINDOW, ROUNDS, RATES = 512, 2048, 4096, 16, 2, (0.01, 0.005)
#: Characters of text that are counted or scored at a time, and distinct tokens that a task holds.
SLICE, HELD = 40_000_000, 150_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_DOUBLINGS = (KNOWN // OWN).bit_length() - 1
CLASSES = OWN // MEMBERS + _DOUBLINGS + 1
#: Inputs: own tokens, then the classes of the others, then the beginning of a document.
_INPUTS = OWN + _DOUBLINGS + 2
_NEVER, _MOST, _COLUMNS = np.float32(-1e4), np.float32(60), 64


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; its end isn't among them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def _slices(texts: list[str | None], most: int) -> Iterator[slice]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


@dataclass(frozen=True)
class Vocabulary:
    """The known tokens by falling count, their counts, and the sums over all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    types: int

    @property
    def whole(self) -> float:
        """All counts with their smoothing, that of the unknown too."""
        return self.total + EXTRA * (self.types + 1)

    @property
    def rest(self) -> float:
        """What of it the tokens that aren't known have."""
        return max(EXTRA, self.whole - float(self.counts.sum()) - EXTRA * len(self.words))

    def base(self) -> np.ndarray:
        """log10 of the smoothed share of each known token."""
        return np.log10((self.counts + EXTRA) / self.whole)

    def classes(self) -> np.ndarray:
        """The class of each known token, by its rank."""
        rank = np.arange(len(self.words))
        tail = OWN // MEMBERS + np.floor(np.log2(np.maximum(rank, 1) / OWN)).astype(np.int64)
        return np.where(rank < OWN, rank // MEMBERS, tail)

    def masses(self) -> np.ndarray:
        """Smoothed count of each class."""
        out = np.bincount(self.classes(), self.counts + EXTRA, CLASSES).astype(np.float64)
        out[-1] += self.rest
        return out

    def within(self) -> np.ndarray:
        """log10 of the share of its class for each known token that isn't one of the own; 0 for those."""
        share = np.log10((self.counts + EXTRA) / self.masses()[self.classes()])
        share[:OWN] = 0
        return share


class Network:
    """Weights as views of one vector: input gates by symbol, recurrent gates, classes, members of each class."""

    SHAPES = {"g": (_INPUTS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "m": (OWN // MEMBERS, HIDDEN, MEMBERS), "mb": (OWN // MEMBERS, MEMBERS)}
    SIZE = sum(math.prod(s) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            setattr(self, name, flat[at : at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    @classmethod
    def first(cls, vocabulary: Vocabulary, seed: int = 7) -> Network:
        """Small random weights, and biases that give the plain counts."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(cls.SIZE, np.float32))
        net.g[:] = 0.3 * rng.standard_normal(net.g.shape)
        net.g[:, :HIDDEN] -= 1
        net.u[:] = rng.standard_normal(net.u.shape) * 0.5 * HIDDEN**-0.5
        with np.errstate(divide="ignore"):
            net.cb[:] = np.maximum(np.log(vocabulary.masses() / vocabulary.whole), _NEVER)
        net.mb[:] = _NEVER
        own = vocabulary.counts[:OWN] + EXTRA
        net.mb.reshape(-1)[: len(own)] = np.log(own / own.max(initial=1))
        return net


class Lanes:
    """Texts of tokens laid one after the other in lanes of about equal length, the longest lanes first."""

    def __init__(self, sizes: np.ndarray, most: int = LANES):
        heap = [(0, k) for k in range(max(1, min(most, len(sizes), int(sizes.sum()) // LEAST_LANE)))]
        lane, row = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        size = sizes.tolist()
        for i in np.argsort(-sizes, kind="stable").tolist():
            held, k = heap[0]
            lane[i], row[i] = k, held
            heapq.heapreplace(heap, (held + size[i], k))
        load = np.zeros(len(heap), np.int64)
        for held, k in heap:
            load[k] = held
        order = np.argsort(-load, kind="stable")
        self.load = load[order]
        self.end = np.cumsum(self.load)
        self.begin = self.end - self.load
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        texts = np.lexsort((row, place[lane]))
        ends = np.cumsum(sizes[texts])
        #: The texts' first tokens, and where each token was before it was laid in its lane; lanes lie one after the other.
        self.first = ends - sizes[texts]
        self.tokens = np.arange(int(sizes.sum()), dtype=np.int32) + np.repeat((np.cumsum(sizes) - sizes)[texts] - self.first, sizes[texts]).astype(np.int32)

    def places(self, a: int, b: int, width: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Where the tokens of rows a to b of the first lanes lie, and which of them there are (None: all)."""
        at = self.begin[:width] + np.arange(a, b)[:, None]
        inside = at < self.end[:width]
        return (at, None) if inside.all() else (np.where(inside, at, 0), inside)

    def windows(self) -> Iterator[tuple[int, int, int]]:
        """(first row, row after the last, lanes that hold any)."""
        for at in range(0, int(self.load[0]) if len(self.load) else 0, WINDOW):
            yield at, min(at + WINDOW, int(self.load[0])), int((self.load > at).sum())


def _inputs(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What is read before each token: the one before it, or the beginning."""
    out = np.empty_like(symbols)
    out[1:] = symbols[:-1]
    out[first] = _INPUTS - 1
    return out


class _Window:
    """Arrays of a window (T, B): gates, what each step made, and the state before it."""

    def __init__(self, steps: int, batch: int, kind: np.dtype):
        made = lambda n: np.empty((steps, batch, n), kind)
        self.x, self.zr, self.n, self.hn, self.before, self.h = made(3 * HIDDEN), made(2 * HIDDEN), made(HIDDEN), made(HIDDEN), made(HIDDEN), made(HIDDEN)


def forward(net: Network, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> _Window:
    """The states after each input; where ``fresh`` the state before it is zero. Both gates are 1 / (1 + exp(their sum))."""
    w = _Window(*inputs.shape, net.flat.dtype)
    np.take(net.g, inputs, axis=0, out=w.x, mode="clip")
    some = fresh.any(axis=1)
    with np.errstate(over="ignore"):
        for t in range(len(inputs)):
            before, zr, n, new = w.before[t], w.zr[t], w.n[t], w.h[t]
            before[:] = h
            if some[t]:
                before[fresh[t]] = 0
            hu = before @ net.u
            np.add(w.x[t, :, : 2 * HIDDEN], hu[:, : 2 * HIDDEN], out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            w.hn[t] = hu[:, 2 * HIDDEN :]
            np.multiply(zr[:, HIDDEN:], w.hn[t], out=n)
            n += w.x[t, :, 2 * HIDDEN :]
            np.tanh(n, out=n)
            np.subtract(before, n, out=new)
            new *= zr[:, :HIDDEN]
            new += n
            h = new
    return w


def _softmax(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of the targets, the sums); ``z`` becomes the powers of e."""
    np.minimum(z, _MOST, out=z)
    chosen = z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + target]
    np.exp(z, out=z)
    total = np.maximum(z.sum(axis=1), np.float32(1e-30))
    return chosen - np.log(total), total


def class_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < OWN, symbols // MEMBERS, symbols - OWN + OWN // MEMBERS)


def _output(net: Network, states: np.ndarray, symbols: np.ndarray, grad: Network | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probabilities (n) of tokens by the states before them; with ``grad`` also the gradient of the states, and that of the weights in it."""
    out, kind = np.empty(len(symbols), states.dtype), class_of(symbols)
    ds = np.empty_like(states) if grad is not None else None
    for k in range(0, len(symbols), 1024):
        part, own = states[k : k + 1024], kind[k : k + 1024]
        z = part @ net.c
        z += net.cb
        out[k : k + 1024], total = _softmax(z, own)
        if grad is not None:
            z /= total[:, None]
            z.reshape(-1)[np.arange(0, z.size, CLASSES) + own] -= 1
            grad.c += part.T @ z
            grad.cb += z.sum(axis=0)
            np.dot(z, net.c.T, out=ds[k : k + 1024])
    # The own tokens by class: one product for each, all else at once.
    order = np.argsort(np.minimum(kind, OWN // MEMBERS).astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=CLASSES))[: OWN // MEMBERS]
    order = order[: ends[-1]]
    part, own, slot = states[order], kind[order], symbols[order] % MEMBERS
    z = np.empty((len(order), MEMBERS), states.dtype)
    spans = [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)) if b > a]
    for c, a, b in spans:
        np.dot(part[a:b], net.m[c], out=z[a:b])
        z[a:b] += net.mb[c]
    lp, total = _softmax(z, slot)
    out[order] += lp
    if grad is not None and len(order):
        z /= total[:, None]
        z.reshape(-1)[np.arange(0, z.size, MEMBERS) + slot] -= 1
        back = np.empty_like(part)
        for c, a, b in spans:
            np.dot(part[a:b].T, z[a:b], out=grad.m[c])
            np.dot(z[a:b], net.m[c].T, out=back[a:b])
        grad.mb[[c for c, _, _ in spans]] = np.add.reduceat(z, [a for _, a, _ in spans], axis=0)
        ds[order] += back
    return out, ds


def log_probabilities(net: Network, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each token's class, and of an own token within its class; texts one after the other."""
    lanes = Lanes(sizes)
    inputs = _inputs(symbols, np.cumsum(sizes) - sizes)[lanes.tokens]
    symbols, new = symbols[lanes.tokens], np.zeros(len(symbols), bool)
    new[lanes.first] = True
    laid, h = np.zeros(len(symbols), np.float32), np.zeros((len(lanes.load), HIDDEN), net.flat.dtype)
    for a, b, width in lanes.windows():
        at, inside = lanes.places(a, b, width)
        w = forward(net, inputs[at], new[at], h[:width])
        h, at, states = w.h[-1], at.ravel(), w.h.reshape(-1, HIDDEN)
        if inside is not None:
            states, at = states[inside.ravel()], at[inside.ravel()]
        laid[at] = _output(net, states, symbols[at])[0]
    out = np.empty(len(symbols))
    out[lanes.tokens] = laid
    return out


def gradients(net: Network, inputs: np.ndarray, symbols: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of a window (T, B): the sum of the losses, the gradient of all weights, the states after it. Symbols under 0 are padding."""
    steps, batch = symbols.shape
    w, grad = forward(net, inputs, fresh, h), Network(np.zeros_like(net.flat))
    flat, target = w.h.reshape(-1, HIDDEN), symbols.ravel()
    if target.min() >= 0:
        lp, ds = _output(net, flat, target, grad)
    else:
        real = np.flatnonzero(target >= 0)
        lp, some = _output(net, flat[real], target[real], grad)
        ds = np.zeros_like(flat)
        ds[real] = some
    ds = ds.reshape(steps, batch, HIDDEN)
    z, r = w.zr[:, :, :HIDDEN], w.zr[:, :, HIDDEN:]
    # What a change of the state makes of each gate's sum, but for that change.
    by_n = (1 - z) * (1 - w.n * w.n)
    by_z = (w.n - w.before) * z * (1 - z)
    by_r = w.hn * r * (r - 1)
    dx, dhu = w.x, np.empty_like(w.x)
    dh, turned, some = np.zeros_like(h), net.u.T.copy(), fresh.any(axis=1)
    for t in range(steps - 1, -1, -1):
        dh += ds[t]
        x, y = dx[t], dhu[t]
        dn = x[:, 2 * HIDDEN :]
        np.multiply(dh, by_n[t], out=dn)
        np.multiply(dh, by_z[t], out=x[:, :HIDDEN])
        np.multiply(dn, by_r[t], out=x[:, HIDDEN : 2 * HIDDEN])
        y[:, : 2 * HIDDEN] = x[:, : 2 * HIDDEN]
        np.multiply(dn, r[t], out=y[:, 2 * HIDDEN :])
        dh *= z[t]
        dh += y @ turned
        if some[t]:
            dh[fresh[t]] = 0
    grad.u[:] = w.before.reshape(-1, HIDDEN).T @ dhu.reshape(-1, 3 * HIDDEN)
    order = np.argsort(inputs.ravel().astype(np.uint16), kind="stable")
    ordered = inputs.ravel()[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    grad.g[ordered[starts]] = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], starts, axis=0)
    return -float(lp.sum(dtype=np.float64)), grad.flat, w.h[-1]


class _Adam:
    def __init__(self, size: int):
        self.m, self.s, self.x, self.t = (*(np.zeros(size, np.float32) for _ in range(3)), 0)

    def step(self, flat: np.ndarray, g: np.ndarray, rate: float) -> None:
        self.t += 1
        m, s, x = self.m, self.s, self.x
        m *= 0.9
        m += np.multiply(g, 0.1, out=x)
        s *= 0.99
        np.multiply(g, g, out=x)
        x *= 0.01
        s += x
        np.sqrt(s, out=x)
        x *= (1 - 0.99**self.t) ** -0.5
        x += 1e-6
        np.divide(m, x, out=x)
        x *= rate / (1 - 0.9**self.t)
        flat -= x


def learn(net: Network, adam: _Adam, symbols: np.ndarray, sizes: np.ndarray, rate: float) -> float:
    """Once through texts that lie one after the other, a step for each window. The sum of the losses.

    A text of more than ``PIECE`` tokens is read in so many at a time, in different lanes, so the state isn't carried from one to the next.
    """
    pieces = -(-sizes // PIECE)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lanes, loss = Lanes(np.minimum(PIECE, sizes[owner] - number * PIECE)), 0.0
    inputs = _inputs(symbols, np.cumsum(sizes) - sizes)[lanes.tokens]
    symbols, new = symbols[lanes.tokens], np.zeros(len(symbols), bool)
    new[lanes.first] = True
    h = np.zeros((len(lanes.load), HIDDEN), net.flat.dtype)
    for a, b, width in lanes.windows():
        at, inside = lanes.places(a, b, width)
        part = symbols[at] if inside is None else np.where(inside, symbols[at], -1)
        lost, g, h = gradients(net, inputs[at], part, new[at], h[:width])
        g *= np.float32(1 / max(1, int((part >= 0).sum())))
        adam.step(net.flat, g, rate)
        loss += lost
    return loss


class _Reader:
    """Texts as known tokens' numbers, and as symbols of the network."""

    def __init__(self, vocabulary: Vocabulary):
        self.place = {w: k for k, w in enumerate(vocabulary.words)}
        self.end = self.place.get(b"", -1)
        rank = np.arange(len(vocabulary.words))
        self.symbol = np.append(np.where(rank < OWN, rank, vocabulary.classes() - OWN // MEMBERS + OWN), _INPUTS - 2).astype(np.int16)

    def __call__(self, texts: list[str | None], others: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all tokens with ends, -1 if not known; tokens of each text). ``others`` gets the tokens of each text that aren't known, with their numbers."""
        get, parts = self.place.get, []
        for text in texts:
            words = tokens(text)
            own = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
            parts.append(own)
            if others is not None:
                others.append([(w.decode(), n) for w, n in Counter([words[k] for k in np.flatnonzero(own < 0).tolist()]).items()])
        sizes = np.array([len(own) + 1 for own in parts], np.int64)
        numbers = np.full(int(sizes.sum()), self.end, np.int32)
        inner = np.ones(len(numbers), bool)
        inner[np.cumsum(sizes) - 1] = False
        numbers[inner] = np.concatenate(parts)
        return numbers, sizes


def count_tokens(rows: DataFrame) -> DataFrame:
    """(token, n) of the texts; the end's token is ''."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
            held.clear()
            return made

        for batch in batches:
            texts = batch.column(0).to_pylist()
            held[b""] += len(texts)
            for text in texts:
                held.update(tokens(text))
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    return rows.mapInArrow(work, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, known: int = KNOWN) -> tuple[Vocabulary, int]:
    """The known tokens and the least count among them: whole steps of the count, from the highest down, while they are at most ``known``, and the end."""
    step = F.floor(F.log2("n") * 16)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("types"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, held = (1 << 62), 0
    for r in sizes:
        held += r["types"]
        if held > known:
            break
        least = r["least"]
    top = sorted(((-r["n"], r["token"].encode()) for r in counts.where((F.col("n") >= least) | (F.col("token") == "")).collect()))
    return Vocabulary([w for _, w in top], np.array([-n for n, _ in top], np.int64), sum(r["n"] for r in sizes), sum(r["types"] for r in sizes)), least


def train(rows: DataFrame, words: Vocabulary, shared, rounds: int = ROUNDS) -> Network:
    """The network after all rounds; ``rows`` has texts alone and ``shared`` is the broadcast vocabulary."""
    net = Network.first(words)
    fields = [f"v{k}" for k in range(_COLUMNS)]
    schema = "place int, seen double, " + ", ".join(f"{f} double" for f in fields)
    for n in range(rounds):
        begin, rate = net.flat.copy(), RATES[min(n, len(RATES) - 1)]

        def work(batches: Iterator[pa.RecordBatch], begin: np.ndarray = begin, rate: float = rate) -> Iterator[pa.RecordBatch]:
            own, adam, read, seen = Network(begin.copy()), _Adam(Network.SIZE), _Reader(shared.value), 0
            for batch in batches:
                for part in _slices(texts := batch.column(0).to_pylist(), SLICE):
                    numbers, sizes = read(texts[part])
                    learn(own, adam, read.symbol[numbers], sizes, rate)
                    seen += len(numbers)
            if seen:
                table = np.zeros(-(-Network.SIZE // _COLUMNS) * _COLUMNS)
                table[: Network.SIZE] = own.flat.astype(np.float64) * seen
                table = table.reshape(-1, _COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table), dtype=np.int32)), pa.array(np.full(len(table), float(seen))), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], names=["place", "seen", *fields])

        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == n).select("text")
        # A row for every _COLUMNS weights: as many as the network has, however many tasks there were.
        summed = part.mapInArrow(work, schema).groupBy("place").agg(*(F.sum(c).alias(c) for c in ("seen", *fields))).orderBy("place").collect()
        if summed:
            net = Network((np.array([r[2:] for r in summed]) / np.array([[r["seen"]] for r in summed])).ravel()[: Network.SIZE].astype(np.float32))
    return net


def _scored(docs: DataFrame, net: Network, shared) -> DataFrame:
    """By document: its tokens, what the known ones give, and the others with their numbers."""
    kind, flat = docs.schema["doc_id"].dataType.simpleString(), net.flat
    rest = pa.map_(pa.string(), pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = shared.value, Network(flat)
        read, base, within = _Reader(words), np.append(words.base(), 0.0), np.append(words.within(), 0.0)
        for batch in batches:
            for part in _slices(texts := batch.column(1).to_pylist(), SLICE):
                others: list[list[tuple[str, int]]] = []
                numbers, sizes = read(texts[part], others)
                first = np.cumsum(sizes) - sizes
                learned = log_probabilities(own, read.symbol[numbers], sizes) / math.log(10) + within[numbers]
                known = np.add.reduceat((numbers >= 0).astype(np.int64), first)
                cells = [batch.column(0)[part], sizes, known, np.add.reduceat(base[numbers], first), np.add.reduceat(learned, first)]
                yield pa.RecordBatch.from_arrays([cells[0], *map(pa.array, cells[1:]), pa.array(others, rest)], names=["doc_id", "n_tokens", "known", "base", "learned", "others"])

    return docs.mapInArrow(work, f"doc_id {kind}, n_tokens long, known long, base double, learned double, others map<string,bigint>")


def document_scores(docs: DataFrame, fold: int = 10, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))
    training = texts.where(~held).select("text")
    counts = written(count_tokens(training))
    words, least = vocabulary(counts, known)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    net = train(training, words, shared)
    scored = written(_scored(texts, net, shared).withColumn("row", F.monotonically_increasing_id()), compression="zstd")
    # A token that isn't known has fewer counts than those that are, so none of them is a hot key of the counts.
    rare = counts.where(F.col("n") < least)
    each = scored.select("row", F.explode("others").alias("token", "times")).join(rare, "token", "left")
    n = F.coalesce("n", F.lit(0)) + EXTRA
    sums = each.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(n / words.whole)).alias("more_base"), F.sum(F.col("times") * F.log10(n / float(words.masses()[-1]))).alias("more_learned")
    )
    out = scored.drop("others").join(sums, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias
    return out.select("doc_id", held.alias("held_out"), "n_tokens", plus("known", "more")("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), plus("base", "more_base")("base_score"), plus("learned", "more_learned")("score"))
