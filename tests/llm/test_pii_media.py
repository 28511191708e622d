"""Personal data and media columns against brute force."""

import hashlib
import io
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafthorn.llm import media, pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    "x@y.z a@b.c_d@e.f, a@b.c..d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111  5 12",
    "",
    None,
    "+1 (234) 567-8901 +++1 2 é😀 4111-1111-1111-1111 IBAN DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 GB83WEST12345698765432 ssn 123-45-6789",
    " 0001.2.3.4 1.2.3.0000255 1.2.3.256",
    "1 " * 3000,
    "é" * 500 + "a@b.co " + "9" * 30,
    "no data at all",
    "no data at all",
]


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def test_spans(docs_of):
    got = {r.doc_id: r for r in pii.pii_spans(docs_of(enumerate(TEXTS))).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        spans = brute(text)
        named = [f"{k}:{s}:{e}" for s, _, e, k in spans]
        assert got[i].base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[3] == k for x in spans) for k in BASE]
        assert [x for x in got[i].spans.split(",") if x.split(":")[0] in BASE] == named or not named
    assert got[3].spans.count("iban:") == 2 and "nid:" in got[3].spans


def test_redaction(spark, docs_of):
    docs = docs_of([(1, "to a@b.co or 1.2.3.4."), (2, None), (3, "clean")]).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: (r.text, r.n_chars, r.bucket) for r in pii.redacted(docs).collect()}
    assert got == {1: ("to <EMAIL> or <IP>.", 19, "k"), 2: (None, None, "k"), 3: ("clean", 5, "k")}
    assert pii.redacted(docs).columns == docs.columns


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert pii.pii_spans(empty).count() == media.text_as_media(empty).count() == pii.redacted(empty).count() == 0


def test_text_round_trip(docs_of):
    texts = [*TEXTS, "x" * 64, "y" * 65]
    got = {r.doc_id: r for r in media.text_as_media(docs_of(enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        encode = (media.encode_pgm, media.encode_bmp)[zlib.crc32(payload) & 1]
        stored = encode(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        tile = np.load(io.BytesIO(r.tile))
        whole = media.area_resize(np.frombuffer(payload, np.uint8).reshape(-1, 64, 1), 8, 8)
        assert tile.shape == (8, 8, 1) and np.abs(tile - whole).max() <= 0.5 and r.feature.endswith(f":{zlib.crc32(r.tile):08x}")
    assert got[7].feature == got[8].feature and {r.format for r in got.values()} == {"pgm", "bmp"}


@pytest.mark.parametrize("shape,to", [((16, 18), (8, 9)), ((7, 5), (3, 4)), ((3, 2), (8, 9)), ((9000, 3), (8, 2))])
def test_area_resize(shape, to):
    image = np.random.default_rng(1).integers(0, 256, (*shape, 1)).astype(np.uint8)
    rows = np.array([[max(0.0, min(i + 1, (k + 1) * shape[0] / to[0]) - max(i, k * shape[0] / to[0])) for i in range(shape[0])] for k in range(to[0])]) * to[0] / shape[0]
    cols = np.array([[max(0.0, min(i + 1, (k + 1) * shape[1] / to[1]) - max(i, k * shape[1] / to[1])) for i in range(shape[1])] for k in range(to[1])]) * to[1] / shape[1]
    assert np.allclose(media.area_resize(image, *to)[:, :, 0], rows @ image[:, :, 0].astype(float) @ cols.T)


def test_decoders(spark):
    grey = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert (media.decode(media.encode_pgm(grey))[:, :, 0] == grey).all()
    assert (media.decode(media.encode_bmp(grey))[:, :, 0] == grey).all()
    assert media.decode(b"P3 # c\n2 1\n255\n1 2 3 4 5 6").tolist() == [[[1, 2, 3], [4, 5, 6]]]
    bmp = struct.pack("<2sIHHI", b"BM", 62, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, -2, 1, 24, 0, 8, 0, 0, 0, 0) + bytes([3, 2, 1, 0, 6, 5, 4, 0])
    assert media.decode(bmp).tolist() == [[[1, 2, 3]], [[4, 5, 6]]]
    rows = [(1, bytearray(media.encode_bmp(grey))), (2, None), (3, bytearray(b"GIF89a")), (4, bytearray(b"P5 9 9 255 x"))]
    got = {r.media_id: r for r in media.media_features(spark.createDataFrame(rows, "media_id long, media binary")).collect()}
    assert (got[1].height, got[1].width, got[1].bands, len(got[1].dhash)) == (5, 7, 1, 16)
    assert np.load(__import__("io").BytesIO(got[1].tile)).shape == (32, 32, 1)
    assert got[2].dhash is None and got[2].error is None and got[3].error and got[4].error


@pytest.mark.parametrize("bad", [b"P2 1 1 255 99999999999999999999", b"P2 1 1 255 -3", b"P2 1 1 9 10", b"P5 1 1 9\n\xff", b"P5 99999999 99999999 255 x", b"P6", b"BM", b"BM" + bytes(60), b"BM" + b"\xff" * 60, b"P2 0 1 255 ", b"", b"P3 1 1 255 1 2 x"])
def test_bad_images_have_a_reason(spark, bad):
    row = media.media_features(spark.createDataFrame([(1, bytearray(bad))], "media_id long, media binary")).first()
    assert row.dhash is None and row.error


def test_long_texts_of_many_matches(docs_of):
    """About 250 kB each: the time must not grow with the square of the number of matches."""
    texts = ["4111 1111 1111 1111, " * 12_000, "a@b.co é " * 28_000, "1.2.3.4 " * 32_000, "+1 234 567 8901; " * 15_000]
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.pii_spans(docs_of(enumerate(texts))).collect()}
    clean = {r.doc_id: r.text for r in pii.redacted(docs_of(enumerate(texts))).collect()}
    assert time.monotonic() - began < 90
    assert [got[0].n_card, got[1].n_email, got[2].n_ip, got[3].n_phone] == [12_000, 28_000, 32_000, 15_000]
    for i, text in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in brute(text)).encode()).hexdigest()
    assert clean == {0: "<CARD>, " * 12_000, 1: "<EMAIL> é " * 28_000, 2: "<IP> " * 32_000, 3: "<PHONE>; " * 15_000}
