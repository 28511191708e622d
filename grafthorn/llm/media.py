"""Media columns: Netpbm and BMP images decoded to numpy, resized, tiled as NPY, hashed.

``decode`` reads P2, P3, P5, P6 (8 and 16 bit) and uncompressed 8 and 24 bit BMP.
``area_resize`` averages exact pixel areas with integral images taken over bands of
rows, so memory doesn't follow the image's height. ``media_features`` is the operator:
media bytes in, shape, NPY tile and difference hash out. ``text_as_media`` stores texts as images,
64 samples wide.

Null media: null features. Media that can't be decoded: null features and the
reason in ``error``. Null and empty texts: one row of 64 zero samples.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grafthorn.llm.common import rows

WIDTH = 64
_BAND = 4096
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit grey samples (height, width) as binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey samples (height, width) as BMP with a grey palette, rows padded to 4 bytes."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", at + body.size, 0, 0, at)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, body.size, 2835, 2835, 256, 256) + palette.tobytes() + body.tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[:2], 2, []
    for _ in range(3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("header ends early")
        head.append(int(m[1]))
        at = m.end()
    width, height, top = head
    bands = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * bands
    if not 0 < top < 65536 or n <= 0:
        raise ValueError("bad size or maximum")
    if n > len(data) * 2:
        raise ValueError("samples are missing")
    if kind in (b"P2", b"P3"):
        flat = np.array(data[at:].split()[:n], dtype=np.int64)
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", count=n, offset=at + 1)
    if len(flat) < n:
        raise ValueError("samples are missing")
    if flat.min() < 0 or flat.max() > top:
        raise ValueError("a sample is outside 0 to the maximum")
    return flat.astype(np.uint8 if top < 256 else np.uint16, copy=False).reshape(height, width, bands)


def _decode_bmp(data: bytes) -> np.ndarray:
    (at,) = struct.unpack_from("<I", data, 10)
    header, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed 8 and 24 bit BMP")
    if width <= 0 or not height or header < 12 or at < 14 + header:
        raise ValueError("bad size or header")
    stride = (width * bits // 8 + 3) // 4 * 4
    lines = np.frombuffer(data, np.uint8, count=stride * abs(height), offset=at).reshape(abs(height), stride)
    lines = lines[::-1] if height > 0 else lines
    if bits == 24:
        return lines[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1]
    colours = (at - 14 - header) // 4
    palette = np.frombuffer(data, np.uint8, count=colours * 4, offset=14 + header).reshape(colours, 4)[:, 2::-1]
    pixels = palette[lines[:, :width]]
    return pixels[:, :, :1] if (palette == palette[:, :1]).all() else pixels


def decode(data: bytes) -> np.ndarray:
    """Samples (height, width, 1 or 3) of a Netpbm or BMP image."""
    if data[:2] in (b"P2", b"P3", b"P5", b"P6"):
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * (size / parts)
    whole = np.minimum(at.astype(np.int64), size)
    return whole, at - whole


def _sums_along(integral: np.ndarray, whole: np.ndarray, part: np.ndarray, axis: int) -> np.ndarray:
    """Integral at fractional places, linear between whole ones, then differences."""
    low = np.take(integral, whole, axis=axis)
    high = np.take(integral, np.minimum(whole + 1, integral.shape[axis] - 1), axis=axis)
    shape = [1] * integral.ndim
    shape[axis] = -1
    return np.diff(low + (high - low) * part.reshape(shape), axis=axis)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, as float64 (height, width, bands)."""
    rows_in, cols_in, bands = image.shape
    cols, cols_part = _edges(cols_in, width)
    lines, lines_part = _edges(rows_in, height)
    at = np.unique(np.concatenate([lines, np.minimum(lines + 1, rows_in)]))
    kept = np.zeros((len(at), width, bands))
    total, top = np.zeros((width, bands)), 0
    for top in range(0, rows_in, _BAND):
        band = image[top : top + _BAND].astype(np.float64)
        integral = np.zeros((band.shape[0] + 1, cols_in + 1, bands))
        integral[1:, 1:] = band.cumsum(axis=0).cumsum(axis=1)
        across = _sums_along(integral, cols, cols_part, axis=1) + total
        here = (at >= top) & (at <= top + band.shape[0])
        kept[here] = across[at[here] - top]
        total = across[-1]
    low, high = kept[np.searchsorted(at, lines)], kept[np.searchsorted(at, np.minimum(lines + 1, rows_in))]
    sums = np.diff(low + (high - low) * lines_part[:, None, None], axis=0)
    return sums / (rows_in / height) / (cols_in / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: is each of 8x9 mean greys lighter than its right neighbour?"""
    small = area_resize(image, 8, 9).mean(axis=2)
    bits = np.packbits((small[:, :-1] > small[:, 1:]).ravel())
    return bits.tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The image area-resized to side x side, as the bytes of an NPY file of uint8."""
    out = io.BytesIO()
    scale = 1.0 if image.dtype == np.uint8 else 255 / 65535
    np.save(out, np.clip(np.rint(area_resize(image, side, side) * scale), 0, 255).astype(np.uint8))
    return out.getvalue()


def media_features(media: DataFrame, key: str = "media_id", column: str = "media", side: int = 32) -> DataFrame:
    """Height, width, bands, NPY tile and difference hash of each image in a binary column.

    One narrow pass; rows stay whole, repeated rows give repeated results.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    image = decode(data) if data is not None else None
                    out.append((*image.shape, npy_tile(image, side), difference_hash(image), None) if image is not None else (None,) * 6)
                except (ValueError, OverflowError, IndexError, struct.error) as e:
                    out.append((None, None, None, None, None, str(e)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["key", "height", "width", "bands", "tile", "dhash", "error"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(work, f"`{key}` {kind}, height long, width long, bands long, tile binary, dhash string, error string")


def text_as_media(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Store each whole text as an image of ``width`` samples a row and describe what is read back.

    The payload is the text's UTF-8 (null: empty), then zero bytes up to a positive
    multiple of ``width``. It is stored as PGM where its CRC-32 is even, else as BMP (``format``). ``tile`` is the decoded image
    resized to 8x8 as an NPY file, ``feature`` its difference hash, a colon, and the tile's CRC-32; equal texts give equal rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "format", "tile"]
        kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            out = []
            for (value,) in rows([batch], 1):
                raw = (value or "").encode("utf-8")
                height = max(1, -(-len(raw) // width))
                samples = np.zeros(height * width, np.uint8)
                samples[: len(raw)] = np.frombuffer(raw, np.uint8)
                form = ("pgm", "bmp")[zlib.crc32(samples) & 1]
                media = (encode_pgm if form == "pgm" else encode_bmp)(samples.reshape(height, width))
                image = decode(media)
                payload, tile = image.tobytes(), npy_tile(image, 8)
                feature = f"{difference_hash(image)}:{zlib.crc32(tile):08x}"
                out.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, form, tile))
            cols = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, format string, tile binary")
