"""Shared helpers: tables, shared-folder materialisation, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
NGRAM = 5
_CACHE_WORDS = 300_000
#: Spark's setting by which a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only where it is
    unset on one machine, as in tests, is a temporary folder chosen.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="grafthorn-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/grafthorn-{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and outlives executors.

    What was shuffled for it is removed at once, so that the disk holds one step's shuffles, not all of a job's until the driver collects garbage.
    """
    path, conf = shared_dir(df.sparkSession), df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if "/grafthorn-" in folder:
            path.getFileSystem(conf).delete(path, True)


def _may_occur(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` with columns named by place, x0, x1, ..., and ``may``: false only where the key doesn't occur in ``wanted``.

    Keys are hashed to a bit map of 256 x 32,768 bits, 1 MB whatever the sizes, which is broadcast. Where
    ``wanted`` is huge the map is full and every row may occur. No name of the caller's is in the plan, so none can clash.
    """
    own = rows.toDF(*(f"x{k}" for k in range(len(rows.columns))))
    parts = lambda c: (F.pmod(F.xxhash64(c), F.lit(256)), F.pmod(F.shiftright(F.xxhash64(c), 8), F.lit(32_768)))
    bucket, place = parts(F.col("key"))
    maps = wanted.select(F.col(key).alias("key")).select(bucket.alias("bucket"), place.alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("map"))
    bucket, place = parts(F.col(f"x{rows.columns.index(key)}"))
    byte = F.conv(F.hex(F.expr("substring(map, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(F.col("place"), F.lit(8)))), F.lit(2)) == 1
    marked = own.withColumns({"bucket": bucket, "place": place}).join(F.broadcast(maps), "bucket", "left")
    return marked.select(*own.columns, F.coalesce(bit, F.lit(False)).alias("may"))


def sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may occur in ``wanted``: all that do, and few others while it is small.

    Before a join on the key this spares the shuffle of most texts that the join would drop.
    """
    return _may_occur(rows, wanted, key).where("may").drop("may").toDF(*rows.columns)


def parted(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key surely doesn't occur in ``wanted``, the others): only the others need a join to tell."""
    marked = _may_occur(rows, wanted, key)
    return marked.where("not may").drop("may").toDF(*rows.columns), marked.where("may").drop("may").toDF(*rows.columns)


class WordHashes(dict):
    """64-bit hash of each word, kept for the words seen lately (memory stays bounded)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, words: WordHashes, n: int = NGRAM) -> np.ndarray:
    """Hash of each run of ``n`` lower-case words, in text order, over the whole text.

    A text of 1 to n-1 words has one shingle, all its words; a null or wordless text none.
    """
    found = WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(n, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return mix(out + np.uint64(width))


def rows(batches: Iterator, *columns: int) -> Iterator[tuple]:
    """Rows of Arrow batches as plain Python values, for the columns at these positions; few at a time, as texts may be long."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)
