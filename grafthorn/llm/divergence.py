"""How the sources of each language differ in their words: exact counts, smoothed shares, and their distances.

Terms are runs of letters and of bytes from 0x80 on, with A-Z in lower case. A lookup table over the concatenated UTF-8 buffer of a
slice of texts finds where they begin and end; each slice of bytes is hashed by xxhash, and every term is compared byte by byte
with the first of its hash, so that a collision can't join two terms. Counts by (lang, source, term) are summed in each slice, then by
Spark before and after the shuffle.

Distances between sources are made by blocks of terms: a block's counts are a CSR matrix (sources x terms) of which
``numpy.add.reduceat`` sums the differences by row; cells that are zero are accounted for by number. Blocks are cut so that each holds
about ``BLOCK`` counts, and rows of more than ``STRIPE`` sources are dealt over several tasks, so no group is unbounded.

Null text, lang and source are ''. A text without terms counts for its group, which comes out even with no terms at all; repeated rows each
count as a document; an empty table gives no rows. Ties go by the item's UTF-8 bytes. Only text, lang and source are read.
Shares are exact while a group's counts and five times its language's terms sum to less than 9e15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafthorn.llm.common import drop_written, written

LEAST_DOCUMENTS, SMOOTHING, SCALE, SHOWN = 30, 5, 1_000_000_000, 50
#: Bytes of text at a time, counts in a block of terms, sources of a lang in a task.
SLICE, BLOCK, STRIPE = 4_000_000, 25_000, 256
#: 0 for bytes that part terms, else the byte, in lower case if it is of A-Z.
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
_COUNTS = "lang string, source string, term string, n long, docs long"


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, after the last) of runs of rows with about ``most`` bytes."""
    if len(sizes):
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)


def boundaries(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by the table, starts, ends and rows of the runs that aren't 0) of a string array; runs end where their text does."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    low = table[np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]] if held is not None and len(held) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = low != 0
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """(the group of each slice, the bytes of each group): by hash, and by exact bytes where a hash has more than one."""
    raw = low.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    found = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    sizes, twin = ends - starts, first[group]
    odd = sizes != sizes[twin]
    # The bytes of all slices, and as many from the start of each one's first; a shorter first is odd already.
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    same = low[starts[owner] + place] == low[np.minimum(starts[twin][owner] + place, max(0, len(low) - 1))]
    odd[owner[~same]] = True
    numbers: dict[bytes, int] = {}
    for i in np.flatnonzero(odd).tolist():
        term = raw[starts[i] : ends[i]]
        if term not in numbers:
            numbers[term] = len(found)
            found.append(term)
        group[i] = numbers[term]
    return group, found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each slice by (lang, source, term), and a row without a term for each group that occurs."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(0)), 0).to_numpy(zero_copy_only=False)
        for a, b in _slices(sizes, SLICE):
            batch = whole.slice(a, b - a)
            code: dict[tuple[str, str], int] = {}
            owners = np.array([code.setdefault((x or "", y or ""), len(code)) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)
            low, starts, ends, row = boundaries(batch.column(0), LETTERS)
            term, terms = grouped(low, starts, ends)
            width = max(1, len(terms))
            by_text, times = np.unique(row * width + term, return_counts=True)
            key = owners[by_text // width] * width + by_text % width
            order = np.argsort(key, kind="stable")
            cells, at = np.unique(key[order], return_index=True)
            n = np.add.reduceat(times[order], at) if len(at) else np.zeros(0, np.int64)
            docs = np.diff([*at.tolist(), len(key)])
            langs, sources = (pa.array([k[i] for k in code], pa.string()) for i in (0, 1))
            group = np.concatenate([np.arange(len(code)), cells // width])
            names = pa.concat_arrays([pa.nulls(len(code), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(cells % width))])
            zeros = np.zeros(len(code), np.int64)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group)), sources.take(pa.array(group)), names, pa.array(np.concatenate([zeros, n])), pa.array(np.concatenate([zeros, docs]).astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def _share(n: str, total: str, terms: str):
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)), exactly."""
    return F.expr(f"1 + (cast({SCALE} as decimal(18,0)) * cast({n} + {SMOOTHING} as decimal(18,0))) div cast({total} + {SMOOTHING} * {terms} as decimal(18,0))").cast("long")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same in 64-bit integers, three decimal places at a time; ``total`` has the smoothing in it."""
    left, out = n + SMOOTHING, np.zeros(len(n), np.int64)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return out + 1


def distances(source: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray, terms: int, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each source marked in ``own`` the sums of absolute differences to all later sources, over all terms.

    ``p`` are the shares of the cells (source, term) that aren't zero, ``base`` is a source's share of a term that it lacks.
    """
    order = np.lexsort((term, source))
    source, term, p = source[order], term[order], p[order]
    indptr = np.searchsorted(source, np.arange(len(base) + 1))
    number = np.diff(indptr)
    for a in np.flatnonzero(own).tolist():
        later = np.arange(a + 1, len(base))
        mine = slice(indptr[a], indptr[a + 1])
        x, has = np.full(terms, base[a]), np.zeros(terms, bool)
        x[term[mine]], has[term[mine]] = p[mine], True
        sums = {k: np.zeros(len(later), np.int64) for k in ("theirs", "both", "shared")}
        rest = slice(indptr[a + 1], len(term))
        full = later[number[later] > 0]
        if len(full):
            at, t, row = indptr[full] - indptr[a + 1], term[rest], source[rest]
            common = has[t]
            for k, cells in (("theirs", np.abs(x[t] - p[rest])), ("both", np.where(common, np.abs(x[t] - base[row]), 0)), ("shared", common.astype(np.int64))):
                sums[k][full - a - 1] = np.add.reduceat(cells, at)
        # Of this source's own cells against the others' base: by sorted shares and their running sums.
        ranked = np.sort(p[mine])
        running = np.concatenate([[0], np.cumsum(ranked)])
        below = np.searchsorted(ranked, base[later])
        against = base[later] * below - running[below] + (running[-1] - running[below]) - base[later] * (len(ranked) - below)
        neither = terms - (len(ranked) + number[later] - sums["shared"])
        yield a, sums["theirs"] + against - sums["both"] + neither * np.abs(base[a] - base[later])


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """Partial sums of all pairs of sources with one in this stripe, over a block of terms."""
    table = table.combine_chunks()
    heads = table.filter(pc.is_null(table["term"])).sort_by("source")
    cells = table.filter(pc.is_valid(table["term"]))
    names = heads["source"].combine_chunks()
    total = (heads["total"].to_numpy() + SMOOTHING * heads["terms"].to_numpy()).astype(np.int64)
    source = pc.index_in(cells["source"], value_set=names).to_numpy().astype(np.int64)
    coded = cells["term"].combine_chunks().dictionary_encode() if cells.num_rows else None
    term, width = (coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)) if coded is not None else (np.zeros(0, np.int64), 0)
    base, p = shares(np.zeros(len(total), np.int64), total), shares(cells["n"].to_numpy().astype(np.int64), total[source])
    lefts, rights, values = [], [], []
    for a, sums in distances(source, term, p, base, width, heads["own"].to_numpy(zero_copy_only=False)):
        lefts.append(np.full(len(sums), a))
        rights.append(np.arange(a + 1, len(names)))
        values.append(sums)
    a, b, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lefts, rights, values))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(value)})


def divergences(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of a lang, and the terms that a source has more of than its lang."""
    counts = written(docs.select(*(F.col(c).cast("string") for c in ("text", "lang", "source"))).mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("everywhere")).where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")
    cells = written(counts.drop("docs").join(kept, ["lang", "term"]))
    of_lang = cells.groupBy("lang").agg(F.sum("n").alias("lang_total")).join(cells.groupBy("lang", "term").agg(F.first("n")).groupBy("lang").agg(F.count("*").alias("terms")), "lang")
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = written(groups.na.fill(0, ["total", "lang_total", "terms"]))
    drop_written(counts)

    # Every pair of a lang's sources, by blocks of terms and stripes of sources.
    blocks = max(1, -(-cells.count() // BLOCK))
    stripes = -(-(groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1) // STRIPE)
    each = groups.select("lang", "source", "total", "terms").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    heads = each.withColumn("own", F.pmod(F.xxhash64("source"), F.lit(stripes)) == F.col("stripe")).where("terms > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = cells.select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    sums = heads.unionByName(spread, allowMissingColumns=True).groupBy("lang", "block", "stripe").applyInArrow(_block, "lang string, a string, b string, value long")
    halves = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    none = each.where("terms = 0 and stripe = 0").select("lang", "source")
    without = none.join(none.withColumnRenamed("source", "b"), "lang").where("source < b").select("lang", F.col("source").alias("a"), "b", F.lit(0).cast("long").alias("value"))
    halves = halves.unionByName(without)
    both = halves.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    # Terms of which a source has a larger share than its lang.
    shared = cells.join(groups, ["lang", "source"]).where("n > 0").withColumn("value", _share("n", "total", "terms") - _share("everywhere", "lang_total", "terms"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = shared.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SHOWN)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
