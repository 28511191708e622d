"""Benchmark decontamination by SimHash of item-sized windows and exact verification.

For each item of n words the windows are all runs of n words of a document. The weight of the shingles that a
window shares with the items bounds its similarity, so only windows where that bound reaches the
threshold are fingerprinted; no window that can reach it is skipped by that.
A window's 64-bit SimHash, over its shingles weighted by their rarity among the items, is looked up in a
multi-index: the bits are cut into ``BLOCKS`` blocks, and any item within ``RADIUS`` bits differs from the
window by at most ``RADIUS // BLOCKS`` bits in one block at least; each item is listed under all such keys of its blocks. Items found so
and within the radius are verified by the exact weighted Jaccard similarity of the shingle multisets, in which
shingles that the item lacks weigh as much as the rarest. Fingerprints and similarities of windows that overlap slide from one to the next, so
time and memory are linear in what the windows cover, whatever the length of an item.

The radius is set by the threshold: two sets of equal size at Jaccard 0.8 differ in 9.7 of 64 bits on average
with a deviation of 2.9; 18 covers 99.8 % there and more above. A random fingerprint finds half of the items in the index: so wide a radius
allows no better, and it is the windows before that are few.

The benchmark is read in parts of at most ``ITEMS_AT_ONCE`` items and ``CHARS_AT_ONCE`` characters, by hash; each part is one
broadcast of bounded size and one more narrow pass over the documents, which are never shuffled. After ``CHAIN`` passes the rows are
written and the broadcasts released, so no size of benchmark needs more memory. Shingles are weighed by the whole benchmark, counted by
Spark where it has several parts, so a match doesn't depend on how the items are parted. Items of fewer than five words are compared on
shingles of all their words. Items and texts that are null, or have no words, match nothing.
Repeated items and rows give repeated results. Only item_id, doc_id and the texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafthorn.llm.common import NGRAM, WORD, WordHashes, drop_written, shingle_hashes, written

THRESHOLD = 0.8
BITS = 64
RADIUS = 18
BLOCKS = 7
ITEMS_AT_ONCE = 4_000
CHARS_AT_ONCE = 1_500_000
CHAIN = 8
#: Shingles that windows fingerprinted at once cover, or four times their size; beyond ``WIDE`` bits are summed a few at a time.
SPAN = 65_536
WIDE = 4_096
_PLACES = np.arange(BITS, dtype=np.uint64)


def simhashes(shingles: np.ndarray, weights: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows [first, end): bit b is set where the shingles with bit b outweigh those without.

    Weights vote as whole millionths, so a window's sum is the same however it is reached.
    """
    whole = np.rint(weights * 1e6).astype(np.int64)[:, None]
    out = np.zeros(len(first), np.uint64)
    step = BITS if len(shingles) <= WIDE else 8
    for at in range(0, BITS, step):
        places = _PLACES[at : at + step]
        sums = np.zeros((len(shingles) + 1, step), np.int64)
        np.cumsum(np.where((shingles[:, None] >> places) & np.uint64(1), whole, -whole), axis=0, out=sums[1:])
        out |= ((sums[end] > sums[first]).astype(np.uint64) << places).sum(axis=1, dtype=np.uint64)
    return out


def simhash(shingles: np.ndarray, weights: np.ndarray) -> int:
    """The fingerprint of all the shingles."""
    return int(simhashes(shingles, weights, np.array([0]), np.array([len(shingles)]))[0])


def starts_around(places: np.ndarray, size: int) -> np.ndarray:
    """Starts, ascending and each once, of the windows of this size that hold one of the places (ascending, each once)."""
    least = np.maximum(places - size + 1, np.concatenate([[places[0] - size], places[:-1]]) + 1)
    number = places - least + 1
    return np.repeat(least - np.cumsum(number) + number, number) + np.arange(number.sum())


def runs(starts: np.ndarray, size: int) -> list[np.ndarray]:
    """The starts cut where windows don't overlap, and where they would cover more than is summed at once."""
    out = []
    for part in np.split(starts, np.nonzero(np.diff(starts) > size)[0] + 1):
        blocks = (part - part[0]) // max(SPAN, 4 * size)
        out += np.split(part, np.nonzero(np.diff(blocks))[0] + 1)
    return out


def hamming_blocks(bits: int = BITS, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(shift, mask) of blocks that cover all bits."""
    edges = [round(k * bits / blocks) for k in range(blocks + 1)]
    return [(low, (1 << (high - low)) - 1) for low, high in zip(edges, edges[1:], strict=False)]


def near_keys(key: int, mask: int, most: int) -> list[int]:
    """All keys of a block that differ from this one by at most ``most`` bits."""
    return [key ^ sum(1 << b for b in flipped) for n in range(most + 1) for flipped in combinations(range(mask.bit_length()), n)]


class BenchmarkIndex:
    """The items of one part: shingle places, weights, fingerprints and their multi-index.

    ``number`` and ``counts`` are of the whole benchmark where the items are not all of it: how many items have words, and in how
    many a shingle is that is in several.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, radius: int = RADIUS, number: int | None = None, counts: dict[int, int] | None = None):
        words = WordHashes()
        self.threshold, self.radius = threshold, radius
        self.items: list[tuple[int, np.ndarray, int]] = []
        for item_id, text in items:
            n_words = len(WORD.findall((text or "").lower()))
            if n_words:
                self.items.append((item_id, shingle_hashes(text, words), min(NGRAM, n_words)))
        seen = Counter(int(s) for _, shingles, _ in self.items for s in set(shingles.tolist()))
        if number is None:
            number = len(self.items)
        else:
            seen = {s: counts.get(s, 1) for s in seen}
        self.rarest = float(np.log1p(number))
        self.weight = {s: float(np.log1p(number / n)) for s, n in seen.items()}
        self.prints = [simhash(shingles, self.weights(shingles)) for _, shingles, _ in self.items]
        self.bags = [Counter(shingles.tolist()) for _, shingles, _ in self.items]
        self.totals = [sum(n * self.weight[s] for s, n in bag.items()) for bag in self.bags]
        self.blocks = hamming_blocks()
        self.index: dict[tuple[int, int], list[int]] = {}
        self.sizes: dict[int, dict[int, set[int]]] = {}
        self.lightest: dict[tuple[int, int], float] = {}
        for i, (_, shingles, width) in enumerate(self.items):
            for b, (shift, mask) in enumerate(self.blocks):
                for key in near_keys((self.prints[i] >> shift) & mask, mask, radius // BLOCKS):
                    self.index.setdefault((b, key), []).append(i)
            size = width, len(shingles)
            self.lightest[size] = min(self.lightest.get(size, np.inf), float(self.weights(shingles).sum()))
            for s in shingles.tolist():
                self.sizes.setdefault(width, {}).setdefault(s, set()).add(len(shingles))
        self.sorted = {width: np.array(sorted(found), np.uint64) for width, found in self.sizes.items()}

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        return np.array([self.weight.get(s, self.rarest) for s in shingles.tolist()])

    def near(self, fingerprint: int) -> list[int]:
        """Items within the radius, by way of the blocks in which they are close."""
        found = {i for b, (shift, mask) in enumerate(self.blocks) for i in self.index.get((b, (fingerprint >> shift) & mask), ())}
        return [i for i in found if (self.prints[i] ^ fingerprint).bit_count() <= self.radius]

    def similarity(self, item: int, bag: Counter) -> float:
        own = self.bags[item]
        both = sum(min(n, own[s]) * self.weight[s] for s, n in bag.items() if s in own)
        every = sum(n * (self.weight[s] if s in own else self.rarest) for s, n in bag.items()) + self.totals[item] - both
        return both / every if every else 0.0

    def best_window(self, item: int, shingles: np.ndarray, first: np.ndarray, end: np.ndarray) -> float:
        """The best similarity of an item with windows whose ends ascend; what enters and leaves is counted, and the best window once more as a whole."""
        own, weight, total = self.bags[item], self.weight, self.totals[item]
        base = int(first[0])
        tokens = shingles[base : int(end[-1])].tolist()
        held: dict[int, int] = {}
        low = high = 0
        both = every = 0.0
        top, best = -1.0, (0, 0)
        for a, b in zip((first - base).tolist(), (end - base).tolist(), strict=True):
            if a >= high:
                low = high = a
                held, both, every = {}, 0.0, 0.0
            while high < b:
                s = tokens[high]
                held[s] = n = held.get(s, 0) + 1
                mine = own.get(s, 0)
                every += weight[s] if mine else self.rarest
                both += weight[s] if n <= mine else 0.0
                high += 1
            while low < a:
                s = tokens[low]
                n, mine = held[s], own.get(s, 0)
                held[s] = n - 1
                every -= weight[s] if mine else self.rarest
                both -= weight[s] if n <= mine else 0.0
                low += 1
            whole = every + total - both
            if whole > 0 and both / whole > top:
                top, best = both / whole, (a, b)
        return self.similarity(item, Counter(tokens[best[0] : best[1]]))

    def windows(self, width: int, shingles: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(size, starts) of the item-sized windows that may reach the threshold with an item of their size.

        The weight that a window shares with an item is at least the threshold's share of the item's weight; windows
        whose known shingles together weigh less are left out. At the text's ends windows are cut short.
        """
        table = self.sorted[width]
        at = np.searchsorted(table, shingles)
        hits = np.nonzero(table[np.minimum(at, len(table) - 1)] == shingles)[0]
        if not len(hits):
            return []
        known = np.zeros(len(shingles) + 1)
        known[hits + 1] = self.weights(shingles[hits])
        known = known.cumsum()
        by_size: dict[int, list[int]] = {}
        for p in hits.tolist():
            for size in self.sizes[width][int(shingles[p])]:
                by_size.setdefault(size, []).append(p)
        found = []
        for size, places in by_size.items():
            starts = starts_around(np.array(places), size)
            first, end = np.maximum(starts, 0), np.minimum(starts + size, len(shingles))
            # Sums of a long text are a little off, which may only let more windows through.
            starts = starts[known[end] - known[first] >= self.threshold * self.lightest[width, size] - 1e-6]
            if len(starts):
                found.append((size, starts))
        return found

    def matches(self, text: str | None, words: WordHashes) -> dict[int, float]:
        """Best similarity of each item (by id) that a window of the text matches."""
        best: dict[int, float] = {}
        for width in self.sizes:
            shingles = shingle_hashes(text, words, width)
            for size, starts in self.windows(width, shingles) if len(shingles) else ():
                for part in runs(starts, size):
                    first, end = np.maximum(part, 0), np.minimum(part + size, len(shingles))
                    own = shingles[first[0] : end[-1]]
                    prints = simhashes(own, self.weights(own), first - first[0], end - first[0])
                    near_ones: dict[int, list[int]] = {}
                    different, which = np.unique(prints, return_inverse=True)
                    lists = [self.near(f) for f in different.tolist()]
                    for w, k in enumerate(which.tolist()):
                        for i in lists[k]:
                            near_ones.setdefault(i, []).append(w)
                    for i, at in near_ones.items():
                        s = self.best_window(i, shingles, first[at], end[at])
                        if s >= self.threshold - 1e-9 and s > best.get(self.items[i][0], 0.0):
                            best[self.items[i][0]] = s
        return best


def _shingles_of(items: DataFrame) -> DataFrame:
    """(part, shingle) once for each item that has the shingle; an item's first row has a null shingle too, to count items."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column(1).to_pylist()]
            sizes = [len(f) + (len(f) > 0) for f in found]
            flat = [x for f in found if len(f) for x in (None, *f.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(flat, pa.int64())], names=["part", "shingle"])

    return items.select("part", "text").mapInArrow(work, "part long, shingle long")


def _indexes(benchmark: DataFrame, threshold: float) -> Iterator[BenchmarkIndex]:
    """An index for each bounded part of the benchmark."""
    items = benchmark.select("item_id", "text")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // ITEMS_AT_ONCE), -(-chars // CHARS_AT_ONCE))
    if parts == 1:
        yield BenchmarkIndex([tuple(r) for r in items.collect()], threshold)
        return
    # Twice as many parts as full ones would need, so that uneven hashing keeps each within the bound.
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts)))
    found = written(_shingles_of(dealt))
    number = found.where("shingle is null").count()
    several = found.where("shingle is not null").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    counted = written(found.distinct().join(several, "shingle").select("part", "shingle", "n"))
    for k in range(2 * parts):
        counts = {s % 2**64: c for s, c in counted.where(F.col("part") == k).select("shingle", "n").collect()}
        yield BenchmarkIndex([tuple(r) for r in dealt.where(F.col("part") == k).select("item_id", "text").collect()], threshold, number=number, counts=counts)
    drop_written(found)
    drop_written(counted)


def _pass(docs: DataFrame, text: str, shared: Broadcast) -> DataFrame:
    """Append one index's matches to the last column."""
    place = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = WordHashes(), shared.value
        for batch in batches:
            found = []
            for t, before in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                found.append([*before, *({"item": i, "similarity": s} for i, s in sorted(own.matches(t, words).items(), key=lambda x: (x[0] is None, x[0])))])
            column = pa.array(found, batch.schema.field(batch.num_columns - 1).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", to: str = "benchmark_items", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``to``: array of (item, similarity) for the items that some window of the text matches."""
    out, held, last = docs.withColumn(to, F.expr("cast(array() as array<struct<item:bigint,similarity:double>>)")), [], None
    for index in _indexes(benchmark, threshold):
        if len(held) == CHAIN:
            before, out = last, written(out)
            for shared in held:
                shared.unpersist()
            if before is not None:
                drop_written(before)
            held, last = [], out
        held.append(docs.sparkSession.sparkContext.broadcast(index))
        out = _pass(out, text, held[-1])
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending) and the best similarity of each document."""
    found = with_matches(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        (F.size("benchmark_items") > 0).alias("contaminated"),
        F.array_sort(F.col("benchmark_items.item")).alias("item_ids"),
        F.coalesce(F.array_max("benchmark_items.similarity"), F.lit(0.0)).alias("similarity"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark item, whole."""
    mark = "_grafthorn_items"
    return with_matches(docs, benchmark, to=mark).where(F.size(mark) == 0).drop(mark)
