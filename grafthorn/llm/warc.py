"""WARC archives: written by Spark, revisits resolved by payload digest, read back.

``resolve``: headers alone (digest, id, length) are shuffled by digest in a partial
aggregate; the largest id of a digest that occurs more than once is its response. Only those
digests are joined back to the payloads: broadcast where the written table is small, else an
equi-join whose hot partitions Spark can split at run time.

``write_archive``: one record per row. The text writer ends each record with WARC's own
separator, so Spark's committer writes the files, to any file system. Records are written by classes of size, with fewer in a
file the larger they are, so a file's bytes are bounded too.
``read_archive``: records are read one by one from the unpacked stream and cut by their Content-Length, so payloads may hold anything.
``resolved_records`` joins revisits to the responses that they name.

Null payloads count as empty. Payloads under ``min_bytes`` bytes are always responses. Rows
that repeat the response's id and payload are responses too. A null id never becomes
the response where another record has an id; a group of null ids alone has no response to name and
stays responses. Only the id, url and payload columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafthorn.llm.common import rows, shared_dir, written

_END = "\r\n\r\n"
#: Records of a file, by the payload bytes under which they are: at most 512 MB or 1 GB before packing, and beyond that one record.
RECORDS_PER_FILE = ((1 << 18, 2000), (1 << 25, 32), (None, 1))
#: RFC 4648 base32 alphabet.
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Profile of WARC/1.1 for revisits with the same payload.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"


def base32_of_hex(digest: Column) -> Column:
    """A 40-digit hex string as 32 base32 letters."""

    def letter(i: int) -> Column:
        digits, skip = divmod(5 * i, 4)
        value = F.conv(F.substring(F.concat(digest, F.lit("00")), digits + 1, 3), 16, 10).cast("int")
        return F.lit(_B32).substr(F.shiftright(value, 7 - skip).bitwiseAND(31) + 1, F.lit(1))

    return F.concat(*map(letter, range(32)))


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of each row of (page_id, url, html)."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    heads = base.withColumn("_sha1", F.sha1(F.encode("payload", "UTF-8"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("_sha1").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
    firsts = written(firsts.where("_n > 1 and _first is not null").drop("_n"))
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return heads.join(firsts, "_sha1", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        base32_of_hex(F.col("_sha1")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def write_archive(resolved: DataFrame, date: str = "2026-01-01T00:00:00Z", records_per_file: tuple = RECORDS_PER_FILE) -> str:
    """Write gzipped WARC files with fresh headers to a new shared folder and return it."""
    path = shared_dir(resolved.sparkSession)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes"), F.lit(_END))
    is_revisit = F.col("record_type") == "revisit"
    block = F.when(is_revisit, F.col("_http")).otherwise(F.concat("_http", "payload"))
    name = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))),
        F.when(is_revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    least = 0
    for below, number in records_per_file:
        own = resolved.where((F.col("payload_bytes") >= least) & (F.col("payload_bytes") < (below or 1 << 62)))
        records = own.withColumn("_http", http).select(F.concat(head, F.lit(_END), block).alias("value"))
        records.write.mode("append").option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", number).text(path)
        least = below
    return path


def _records(stream: BinaryIO) -> Iterator[tuple]:
    """(type, id, url, refers_to, stated digest, payload) of each record; a revisit's payload is None."""
    while first := stream.readline():
        if not first.startswith(b"WARC/1."):
            raise ValueError("not the first line of a WARC record")
        head = {}
        while (line := stream.readline().decode("utf-8").rstrip("\r\n")) != "":
            name, _, value = line.partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        stream.read(len(_END))
        kind = head["WARC-Type"]
        payload = None if kind == "revisit" else block[block.index(b"\r\n\r\n") + 4 :]
        yield kind, head["WARC-Record-ID"], head.get("WARC-Target-URI"), head.get("WARC-Refers-To"), head["WARC-Payload-Digest"].removeprefix("sha1:"), payload


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, stated_digest, payload_digest, payload_bytes and perhaps payload of each record."""
    names = ["page_id", "url", "record_type", "refers_to", "stated_digest", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str | None) -> int | None:
        digits = (urn or "")[len(_URN) + 1 : -1]
        return int(digits) if digits else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (content,) in rows(batches, 0):
            out, held = [], 0
            for kind, uid, url, refers, stated, payload in _records(gzip.open(io.BytesIO(content))):
                digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.append((number(uid), url, kind, number(refers), stated, digest, None if payload is None else len(payload), payload if with_payload else None))
                held += len(payload or b"")
                if len(out) == 500 or with_payload and held > 1 << 26:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    # A file to a row: a batch of many would hold them all.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(work, "page_id long, url string, record_type string, refers_to long, stated_digest string, payload_digest string, payload_bytes long, payload binary")


def resolved_records(records: DataFrame) -> DataFrame:
    """Give revisits the length and digest of the response that they name."""
    found = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    same = (F.col("refers_to") == F.col("_id")) & (F.col("stated_digest") == F.col("_digest"))
    return records.join(found, same, "left").select(
        "page_id",
        F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
        "url",
    )


def deduplicated_archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages as a deduplicated archive and describe every record as read back."""
    path = write_archive(resolve(pages, min_bytes))
    return resolved_records(written(read_archive(pages.sparkSession, path, with_payload=False).drop("payload")))
