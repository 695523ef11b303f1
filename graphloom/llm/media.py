"""Media columns: texts stored as PNG images in binary columns, read back and hashed.

Encoding: the payload becomes rows of 64 RGB pixels (192 bytes), each row gets
the filter (None, Sub or Up) with the least sum of absolute differences, and the
rows are deflated into IDAT chunks. Decoding walks the chunks, tests every CRC,
inflates and undoes all five PNG filters: None, Sub and runs of Up with numpy,
Average and Paeth, which the encoder here never chooses, pixel by pixel. The feature
is a perceptual hash: luma averaged to 32 x 32 by area (for every height by the same
rule), low-frequency 8 x 8 cosine transform, one bit for each coefficient above the
median.

A null text counts as empty; an empty table gives an empty one. Equal texts give
equal bytes and features. Columns named ``stored`` and ``read`` are replaced, all
others pass through. Rows go through in slices of about a megabyte, so memory is a
few times a slice or the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.text import slices

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def payload(text: str | None) -> bytes:
    """UTF-8 bytes padded with spaces to a positive multiple of 192."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def encode_png(data: bytes) -> bytes:
    """A 64-pixel-wide 8-bit RGB image of ``data`` (a positive multiple of 192 bytes)."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    sub, up = rows.copy(), rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up[1:] -= rows[:-1]
    forms = np.stack([rows, sub, up])
    best = np.abs(forms.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    lines = np.concatenate([best[:, None].astype(np.uint8), forms[best, np.arange(len(rows))]], axis=1)
    packed = zlib.compress(lines.tobytes(), 4)
    head = WIDTH.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    body = [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *body, _chunk(b"IEND", b"")])


def _unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    height, width = out.shape
    pixels = out.reshape(height, width // bpp, bpp)
    sub = np.flatnonzero(kinds == 1)
    pixels[sub] = np.cumsum(pixels[sub], axis=1, dtype=np.uint8)
    zero = np.zeros(width, np.uint8)
    later = np.flatnonzero(kinds >= 2)
    runs = np.split(later, np.flatnonzero((np.diff(later) != 1) | (kinds[later[1:]] != kinds[later[:-1]])) + 1) if len(later) else []
    for run in runs:  # consecutive rows of one filter
        if kinds[run[0]] == 2:
            first = max(0, run[0] - 1)
            out[first : run[-1] + 1] = np.cumsum(out[first : run[-1] + 1], axis=0, dtype=np.uint8)
            continue
        if kinds[run[0]] not in (3, 4):
            raise ValueError(f"unknown filter {kinds[run[0]]}")
        for y in run:
            above, row = (out[y - 1] if y else zero), out[y]
            for x in range(width):
                a = int(row[x - bpp]) if x >= bpp else 0
                b = int(above[x])
                if kinds[y] == 3:
                    guess = (a + b) // 2
                else:
                    c = int(above[x - bpp]) if x >= bpp else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[x] = (int(row[x]) + guess) & 255
    return out


def decode_png(blob: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit grey, RGB or RGBA image without interlace; raises on a damaged file."""
    if blob[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(blob) and not ended:
        size = int.from_bytes(blob[at : at + 4], "big")
        kind, body = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(blob[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"checksum of {kind!r} differs")
        at += 12 + size
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
    if head is None or not ended:
        raise ValueError("chunks are missing")
    width, height, channels = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), {0: 1, 2: 3, 6: 4}[head[9]]
    if head[8] != 8 or head[12]:
        raise ValueError("only 8-bit images without interlace")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * channels)
    return _unfilter(lines, channels)


def _averages(size: int) -> np.ndarray:
    """32 x size: each row averages its share of ``size`` samples."""
    edges = np.arange(33) * size / 32
    lo, hi, at = edges[:-1, None], edges[1:, None], np.arange(size)[None]
    cover = np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None)
    return cover / cover.sum(1, keepdims=True)


def area_rows(samples: np.ndarray, count: int = 32) -> np.ndarray:
    """``samples`` (rows, columns) averaged to ``count`` rows, each over its share of all rows, parts of rows included."""
    height = len(samples)
    edges = np.arange(count + 1) * height
    whole, part = edges // count, (edges % count / count)[:, None]
    below = np.concatenate((np.zeros((1, samples.shape[1])), np.cumsum(samples, axis=0, dtype=np.float64)))
    up_to = below[whole] + part * samples[np.minimum(whole, height - 1)]
    return np.diff(up_to, axis=0) * (count / height)


_COSINE = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(32)[None] + 1) / 64)
_ACROSS = _averages(WIDTH)
_LUMA = np.array([299, 587, 114])


def image_hash(samples: np.ndarray) -> str:
    """16 hexadecimal digits: a bit for each of the 64 lowest frequencies."""
    luma = samples.reshape(len(samples), WIDTH, CHANNELS) @ _LUMA
    low = _COSINE @ (area_rows(luma) / 1000 @ _ACROSS.T) @ _COSINE.T
    bits = (np.round(low, 6) > np.round(np.median(low.ravel()[1:]), 6)).ravel()
    return np.packbits(bits).tobytes().hex()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STORED = _struct(media=T.BinaryType(), n_bytes=T.LongType())
FEATURES = _struct(payload_bytes=T.LongType(), payload_sha256=T.StringType(), tail_crc32=T.LongType(), media_bytes=T.LongType(), media_sha256=T.StringType(), feature=T.StringType())


_STORED = pa.struct([("media", pa.binary()), ("n_bytes", pa.int64())])
_FEATURES = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _read(blob: bytes) -> dict:
    samples = decode_png(blob)
    data = samples.tobytes()
    return {"payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-16:]), "media_bytes": len(blob), "media_sha256": hashlib.sha256(blob).hexdigest(), "feature": image_hash(samples)}


def to_media(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the struct column ``stored`` (media, n_bytes) of its texts."""
    kept = df.drop("stored")
    schema = T.StructType([*kept.schema, T.StructField("stored", STORED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            stored = [{"media": encode_png(payload(t)), "n_bytes": len((t or "").encode("utf-8", "surrogatepass"))} for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stored, _STORED)], schema.names)

    return kept.mapInArrow(run, schema)


def media_features(df: DataFrame, stored: str = "stored") -> DataFrame:
    """``df`` with the struct column ``read`` of what the stored bytes give when read back."""
    kept = df.drop("read")
    schema = T.StructType([*kept.schema, T.StructField("read", FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(batch.schema.get_field_index(stored)).field("media")
            for at in range(0, batch.num_rows, 500):
                read = pa.array([_read(b.as_py()) for b in blobs.slice(at, 500)], _FEATURES)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 500) for c in batch.columns), read], schema.names)

    return kept.mapInArrow(run, schema)
