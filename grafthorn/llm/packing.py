"""Best-fit packing of tokenised documents into fixed-length sequences, with certified bounds.

1. ``token_pieces``: each document's token ids plus an end id, cut into pieces of at
   most ``capacity`` tokens. A null or empty text is the end id alone.
2. ``packed``: pieces are dealt over partitions by hash and each partition is packed by
   best-fit decreasing. Dual feasible functions give a lower bound on the partition's number of
   sequences. A partition that meets its bound keeps all but its last open sequence;
   one with a gap gives the pieces of its emptiest sequences away, enough of them to
   be able to close the gap. What was given away is dealt anew and packed again, until one partition holds the rest, or a round
   gives away more than half of what it got: then the next one keeps all. No round has
   fewer partitions than its pieces ask for, so a task holds about ``per_partition`` of them at most.

Each row has its certificate: ``round``, ``part``, and the sequences that this partition packed (``part_sequences``) with
the proven least number for its pieces (``part_bound``).

Nothing is dropped: each piece is in exactly one sequence. Pieces of equal length are
ordered by (doc_id, piece, ids_crc32), so a rerun after a lost executor gives the same result. Repeated
documents are packed as often as they occur. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from grafthorn.llm.common import drop_written, written

CAPACITY = 4096
END_ID = 1
#: Latin letters and then punctuation. These letters are stable under NFC; U+0130 isn't one letter in lower case.
_WORD_AND_MARKS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)")
#: Chunks that a task keeps, about 200 bytes each, and characters that are encoded at a time.
_CACHE = 600_000
_SLICE_CHARS = 4_000_000
#: Pieces that one task packs.
PER_PARTITION = 100_000
#: A sequence with more free tokens than this share of the capacity is given away where a gap is open.
OPEN_SHARE = 0.005


@lru_cache(maxsize=1)
def _tokenizers(path: str) -> tuple[Tokenizer, Tokenizer, np.ndarray]:
    """The tokenizer, the same without its normaliser and splitter for words that are bare already, and which ids end a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    bare.normalizer = None
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = whole.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        ends[i] = token.endswith("</w>")
    return whole, bare, ends


class _Encoder(dict):
    """Ids of chunks without blanks or line ends, as little-endian bytes; one for each task.

    The tokenizer splits at white space before it merges anything, so chunk by chunk gives the ids of the whole text. A slice's new
    words are encoded together, each once.
    """

    def __init__(self, path: str):
        super().__init__()
        self.whole, self.bare, self.ends = _tokenizers(path)
        # What stands between two blanks in a row.
        self[""] = b""

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of Latin letters, encoded in one text and cut at word ends."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.nonzero(self.ends[ids])[0] + 1
        if len(cuts) != len(words):
            return self._each(words)
        data, places = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [data[x:y] for x, y in zip(places, places[1:], strict=False)]

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        """Add new chunks. Letters and punctuation are split before anything is merged, so words are encoded without their marks."""
        parted = {c: (m[1].lower(), m[2]) for c in chunks if (m := _WORD_AND_MARKS.fullmatch(c))}
        words = list({w for w, _ in parted.values()})
        ids = {w: i for at in range(0, len(words), 1000) for w, i in zip(words[at : at + 1000], self._words(words[at : at + 1000]), strict=True)}
        rest = list({m for _, m in parted.values() if m}.union(c for c in chunks if c not in parted))
        other = {c: i for at in range(0, len(rest), 10_000) for c, i in zip(rest[at : at + 10_000], self._each(rest[at : at + 10_000]), strict=True)}
        other[""] = b""
        for c in chunks:
            word = parted.get(c)
            self[c] = ids[word[0]] + other[word[1]] if word else other[c]

    def ids(self, texts: list[str]) -> list[bytes]:
        # It lower-cases too; where that is certain to be the same, it is done before the look-up.
        chunked = [(t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").split(" ") for t in texts]
        new = set().union(*chunked)
        new.difference_update(self.keys())
        if len(self) + len(new) > _CACHE:
            self.clear()
            self[""] = b""
            new = set().union(*chunked) - {""}
        # Many small objects without cycles are made here: looking for cycles among them is a seventh of the time.
        gc.disable()
        try:
            self._learn(list(new))
        finally:
            gc.enable()
        return [b"".join(map(self.__getitem__, chunks)) for chunks in chunked]


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of whole texts of about ``_SLICE_CHARS`` characters; null is empty."""
    own, held = [], 0
    for t in texts:
        own.append(t or "")
        held += len(own[-1])
        if held >= _SLICE_CHARS:
            yield own
            own, held = [], 0
    if own:
        yield own


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            every = (ids + end for own in _slices(batch.column(1).to_pylist()) for ids in encoder.ids(own))
            for n, ids in enumerate(every):
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    at.append(n)
                    out.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most sequences that any of a family of dual feasible functions proves necessary."""
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    # Rounding functions: k + 1 parts of the capacity, exact multiples keep their size.
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    # Threshold functions: pieces over capacity - a fill a sequence, pieces under a count nothing.
    mass = np.concatenate([[0], np.cumsum(sizes * counts)])
    number = np.concatenate([[0], np.cumsum(counts)])
    for a in sizes[sizes <= capacity // 2][:: max(1, len(sizes) // 512)]:
        low, high = np.searchsorted(sizes, a), np.searchsorted(sizes, capacity - a, side="right")
        full = int(number[-1] - number[high])
        best = max(best, full - (-int(mass[high] - mass[low]) // capacity))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Sequence and offset of each piece, and each sequence's tokens; ``lengths`` must fall.

    Sequences are kept by free space, and the non-empty classes in one bit mask, so the
    tightest fit is found in constant time.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills, bins, offsets = 0, [], [], []
    for length in lengths:
        fitting = mask >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins.append(b)
        offsets.append(fills[b])
        fills[b] += length
        room -= length
        free[room].append(b)
        mask |= 1 << room
    return bins, offsets, fills


def _packer(capacity: int, last: bool, round_no: int):
    """Packs one partition's pieces; rows to give away have no sequence_id."""

    def pack(part: int, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths.tolist(), capacity)
        bound = lower_bound(lengths, capacity)
        given: set[int] = set()
        if not last:
            # Emptiest first: the last open sequence, and where the bound isn't met the others with room.
            by_room = sorted(range(len(fills)), key=lambda b: (fills[b], b))
            keep = capacity * (1 - OPEN_SHARE)
            given = {b for b in by_room[: max(1, 8 * (len(fills) - bound))] if fills[b] < keep}
        base = (round_no << 56) | (part << 28)
        columns = {
            "sequence_id": pa.array([None if b in given else base + b for b in bins], pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
            **{name: pa.array(np.full(len(bins), x, np.int64)) for name, x in (("round", round_no), ("part", part), ("part_sequences", len(fills)), ("part_bound", bound))},
        }
        for name, column in columns.items():
            table = table.append_column(name, column)
        return table

    return pack


def packed(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Add sequence_id, offset and the certificate to pieces (doc_id, piece, start, length, ids_crc32) no longer than ``capacity``.

    The pieces are written to the shared folder first, and so is each round's result.
    """
    pieces = rest = written(pieces)
    columns, number = rest.columns, rest.count()
    added = "sequence_id long, offset long, round long, part long, part_sequences long, part_bound long"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", {added}"
    done, round_no, last = [], 0, False
    while True:
        parts = max(1, -(-number // per_partition))
        last = last or parts == 1
        pack = _packer(capacity, last, round_no)

        def work(batches: Iterator[pa.RecordBatch], pack=pack) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                table = pa.Table.from_batches(held)
                parts_here = np.unique(table.column("_part").to_numpy())
                for p in parts_here:
                    own = table.filter(pc.equal(table.column("_part"), int(p))).drop_columns("_part")
                    yield from pack(int(p), own).to_batches()

        # A partition number decides a row's task; the salt by round parts pieces that met before.
        key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(round_no)), F.lit(parts)).cast("int")
        out = written(rest.withColumn("_part", key).repartition(parts, "_part").mapInArrow(work, schema))
        done.append(out.where("sequence_id is not null"))
        if round_no == 0:
            drop_written(pieces)
        if last:
            break
        rest = out.where("sequence_id is null").select(*columns)
        before, number, round_no = number, rest.count(), round_no + 1
        if number == 0:
            break
        last = 2 * number > before
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result
