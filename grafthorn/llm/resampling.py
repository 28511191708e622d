"""Documents drawn by how much more likely their word n-grams are in a target than in the corpus.

Features are all runs of one to three consecutive words, hashed to ``BUCKETS`` buckets. The texts are read once: each slice of them
becomes one row of packed 16-bit buckets with the offsets of its documents, written to the shared folder. A pass over those streams sorts
each and counts its runs, which Spark sums by bucket; ``BUCKETS`` sums are all that reaches the driver. A last pass
gathers the buckets' gains and sums them by document with ``numpy.add.reduceat``.

The CRC-32 of a run of words is made from those of its words, by tables of the linear map that so many further bytes are.

The documents with the highest scores are found by a range partition: each part's rows are numbered, and the parts' sizes give the
ranks, so no task sees all rows.

A null or wordless text has no features and weight 0; it is never drawn. Repeated rows each count and each come out; among equal scores the
smaller doc_id goes first, a null one last, and rows that repeat a doc_id and score take their ranks in any order. An empty corpus gives no rows, and with an
empty target all gains come from the corpus. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafthorn.llm.common import drop_written, written

BUCKETS, LONGEST, SCALE, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 1000, 20, 5, 42
#: Characters of text in a stream.
SLICE = 500_000
#: A-Z to lower case; blank for bytes that aren't digits, letters or from 0x80 on.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BYTE = np.array([zlib.crc32(bytes([c])) for c in range(256)], np.uint32)
_STEP = _BYTE ^ _BYTE[0]
_BLANK = np.uint32(zlib.crc32(b" "))


def _zero(x: np.ndarray) -> np.ndarray:
    """What one more byte of zeros makes of the register of a CRC, as far as it depends on it."""
    return _STEP[x & np.uint32(255)] ^ (x >> np.uint32(8))


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits by its values for each of the four bytes."""
    return table[..., 0, :].take(x & np.uint32(255)) ^ table[..., 1, :].take((x >> np.uint32(8)) & np.uint32(255)) ^ table[..., 2, :].take((x >> np.uint32(16)) & np.uint32(255)) ^ table[..., 3, :].take(x >> np.uint32(24))


_UNITS = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
#: By 0 to 63 bytes, and by 64, 128, ... bytes.
_SHORT = np.stack(list(accumulate(range(63), lambda t, _: _zero(t), initial=_UNITS)))
_LONG = list(accumulate(range(25), lambda t, _: _apply(t, t), initial=_zero(_SHORT[63])))


def longer(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The part of the CRC of a longer text that comes from its beginning, given that one's CRC and the length of the rest."""
    low = (by & 63).astype(np.intp) * 4
    flat = _SHORT.reshape(-1)
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= flat[(low + k) * 256 + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    more = by >> 6
    for k, table in enumerate(_LONG):
        if not more.any():
            break
        hit = np.flatnonzero(more & 1)
        out[hit] = _apply(table, out[hit])
        more = more >> 1
    return out


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(the buckets of all runs of words of all texts, the number of words of each text)."""
    words = [(t or "").encode("utf-8", "surrogatepass").translate(WORDS).split() for t in texts]
    number = np.array([len(w) for w in words], np.int64)
    flat = [w for own in words for w in own]
    one = np.fromiter(map(zlib.crc32, flat), np.uint32, len(flat))
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    left = np.repeat(np.cumsum(number), number) - np.arange(len(flat))
    table, last = np.zeros((len(flat), LONGEST), np.uint32), one
    table[:, 0] = one
    for n in range(1, LONGEST):
        last = longer(_zero(last[: max(0, len(flat) - n)]) ^ _BLANK, size[n:]) ^ one[n:]
        table[: len(last), n] = last
    return (table % np.uint32(BUCKETS))[left[:, None] > np.arange(LONGEST)].astype("<u2"), number


def _slices(texts: list[str | None]) -> Iterator[slice]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def streams(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(ids, words, offsets, stream): a row for each slice, offsets count the buckets before each text and after all."""
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(texts := batch.column(1).to_pylist()):
                buckets, number = features(texts[part])
                ends = np.cumsum(runs_of(number))
                row = {"ids": pa.array([batch.column(0)[part].to_pylist()], pa.list_(batch.column(0).type)), "words": pa.array([number], pa.list_(pa.int64())), "offsets": pa.array([np.concatenate([[0], ends])], pa.list_(pa.int64())), "stream": pa.array([buckets.tobytes()], pa.binary())}
                yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    return rows.select(key, F.col(text).cast("string").alias(text)).mapInArrow(work, f"ids array<{kind}>, words array<long>, offsets array<long>, stream binary")


def runs_of(words: np.ndarray) -> np.ndarray:
    """How many runs of up to ``LONGEST`` words there are in so many."""
    return sum(np.maximum(words - n, 0) for n in range(LONGEST))


def bucket_counts(packed: DataFrame) -> np.ndarray:
    """Features by bucket: each stream sorted and its runs counted, summed in the task and then by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                ordered = np.sort(np.frombuffer(x.as_buffer(), "<u2"))
                starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[starts]] += np.diff([*starts.tolist(), len(ordered)])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in packed.select("stream").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, both smoothed by one."""
    all_s, all_t = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(SCALE * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def chance(doc_id, seed: int = SEED) -> int:
    """The random part of a document's score, by its id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(packed: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, words) of each document of the streams."""
    kind = packed.schema["ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words = batch.column(0)[k].values, batch.column(1)[k].values.to_numpy()
                offsets = batch.column(2)[k].values.to_numpy()
                number, weight = np.diff(offsets), np.zeros(len(ids), np.int64)
                some = np.flatnonzero(number)
                if len(some):
                    weight[some] = np.add.reduceat(gain[np.frombuffer(batch.column(3)[k].as_buffer(), "<u2")], offsets[some])
                score = weight + np.array([chance(x, seed) for x in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (number, weight, score, words))], names=["doc_id", "n_features", "weight", "score", "words"])

    return packed.mapInArrow(work, f"doc_id {kind}, n_features long, weight long, score long, words long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and the rank of the ``percent`` in a hundred that are drawn."""
    packed = written(streams(docs.select("doc_id", "text")), compression="zstd")
    wanted = written(streams(target.select(F.lit(0).alias("doc_id"), "text")))
    gain = gains(bucket_counts(packed), bucket_counts(wanted))
    drop_written(wanted)
    fit = F.col("words") >= LEAST_WORDS
    keys = [F.when(fit, 0).otherwise(1), F.when(fit, -F.col("score")), F.when(fit, F.col("doc_id")).asc_nulls_last()]
    # Rows that can't be drawn are dealt out by their weight, to lie in no single part.
    keys.insert(2, F.when(~fit, F.xxhash64("doc_id", "n_features")))
    dealt = weights(packed, gain, seed).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The upper bits number the part, the lower 33 the row in it.
    ordered = written(dealt.withColumn("at", F.monotonically_increasing_id()))
    drop_written(packed)
    sizes = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.count_if(fit).alias("fit")).orderBy("part").collect()
    drawn = percent * sum(r["fit"] for r in sizes) // 100
    before = list(accumulate((r["n"] for r in sizes), initial=0))
    # A row for each part, so as many as the shuffle has partitions.
    starts = docs.sparkSession.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=False)], "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    numbered = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(starts), "part", "left")
    return numbered.select("doc_id", "n_features", "weight", "score", F.when(fit & (rank <= drawn), rank).alias("rank"))
