"""Media columns: Netpbm and BMP images in binary columns, decoded to numpy arrays, area-resized by integral
images, written as NPY tiles and given difference hashes.

decode_image reads P1 to P6 Netpbm (8 or 16 bits a sample) and uncompressed BMP (8-bit palette, 24 and 32 bits).
media_features takes any table with an id and a binary image column. Bytes that are no such image, nulls and
empty values give nulls in every feature, never an error.

The query stores each text's bytes, padded with zero bytes to a positive multiple of 64, as the samples of a
binary PGM 64 wide, writes these media to a table in the shared folder, reads them back and takes the features of
what it has read. A null text counts as empty: one row of 64 zero samples. Texts are never cut; a text is held as its
bytes, its image and its tile at once. Equal texts have equal features; repeated rows give repeated rows, and an empty
table an empty result. text_media reads doc_id and text only, media_features the id, the image and the columns asked
for, so others may be called anything; a column to keep must not have the name of a feature.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import cut, schema_with, table

WIDTH = 64
_HEAD = re.compile(rb"(?:\s+|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A 2-d array of 8-bit samples as binary PGM (P5)."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def encode_ppm(samples: np.ndarray) -> bytes:
    height, width, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _HEAD.match(data, at)
        head.append(int(m[1]))
        at = m.end()
    width, height, most = (*head, 1)[:3]
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if min(width, height) < 1 or not 0 < most < 65536:
        raise ValueError("size")
    if kind == 1:
        flat = np.array([49 - b for b in re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n]], np.uint8)
    elif kind < 4:
        flat = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == 4:
        row = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width]
        flat = 1 - bits.ravel()
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(flat) < n:
        raise ValueError("short")
    flat = flat.astype(np.uint16 if most > 255 else np.uint8)
    return flat.reshape(height, width, depth) if depth > 1 else flat.reshape(height, width)


def encode_bmp(samples: np.ndarray) -> bytes:
    """RGB samples, height x width x 3, as an uncompressed 24-bit BMP."""
    height, width, _ = samples.shape
    body = np.zeros((height, (width * 3 + 3) // 4 * 4), np.uint8)
    body[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, width * 3)
    whole = 54 + body.size
    return b"BM" + whole.to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24) + body.tobytes()


def _bmp(data: bytes) -> np.ndarray:
    number = lambda at, n=4, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, head, width, height, bits = number(10), number(14), number(18, signed=True), number(22, signed=True), number(28, 2)
    if number(30) or bits not in (8, 24, 32) or width < 1 or not height:
        raise ValueError("kind")
    stride, rows = (width * bits // 8 + 3) // 4 * 4, abs(height)
    body = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * bits // 8]
    body = body[::-1] if height > 0 else body
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, 4 * (number(46) or 256), 14 + head).reshape(-1, 4)[:, 2::-1]
        return colours[body]
    return body.reshape(rows, width, bits // 8)[:, :, 2::-1].copy()


def decode_image(data: bytes | None) -> np.ndarray | None:
    """height x width (grey) or height x width x 3 (RGB); None for what is no image of these kinds."""
    try:
        if data and data[:1] == b"P" and data[1:2] in b"123456":
            return _netpbm(data)
        if data and data[:2] == b"BM":
            return _bmp(data)
    except (ValueError, AttributeError, IndexError, OverflowError):
        pass
    return None


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target cell is the mean over its area of the source, from the integral image; cell borders between
    samples take their share of the sample."""
    whole = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=whole[1:, 1:])

    def at(table: np.ndarray, n: int) -> np.ndarray:
        place = np.arange(n + 1) * ((table.shape[0] - 1) / n)
        low = np.minimum(place.astype(np.int64), table.shape[0] - 2)
        part = (place - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    corner = at(at(whole, height).T, width).T
    cells = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return cells * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """One bit for each of side x side cells: is it darker than the next to its right. As hexadecimal."""
    small = np.rint(resize_area(grey(image), side, side + 1) * 64)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """The image area-resized to side x side, rounded, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.rint(resize_area(grey(image), side, side)).astype(np.uint16 if image.dtype == np.uint16 else np.uint8))
    return out.getvalue()


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's padded bytes as a PGM."""

    def stored(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [(x.as_py() or "") for x in part.column(1)]
                media = [encode_pgm(np.frombuffer(payload_of(x), np.uint8).reshape(-1, WIDTH)) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(stored, "doc_id long, n_bytes long, media binary")


_FEATURES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("tile", pa.binary())]


def media_row(data: bytes | None) -> tuple:
    image = decode_image(data)
    if image is None:
        return (None,) * len(_FEATURES)
    samples = image.tobytes()
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), *image.shape[:2], npy_tile(image)


def media_features(df: DataFrame, id: str = "doc_id", media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns to keep, and of the decoded samples: payload_bytes, payload_sha256, tail_crc32 (last 64
    bytes), feature (difference hash), height, width, tile (NPY); of the stored bytes: media_bytes, media_sha256."""
    kinds = {"int64": T.LongType(), "string": T.StringType(), "int32": T.IntegerType(), "binary": T.BinaryType()}
    schema = schema_with(df.select(id, *keep), *((n, kinds[str(t)]) for n, t in _FEATURES))

    def features(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [media_row(x.as_py()) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_FEATURES))], names=[*part.schema.names[:-1], *(n for n, _ in _FEATURES)])

    return df.select(id, *keep, media).mapInArrow(features, schema)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    stored = cut(text_media(table(spark, sf_dir, "documents")), "media")
    return media_features(stored, keep=("n_bytes",))
