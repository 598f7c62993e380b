"""Media columns: texts stored losslessly as greyscale PNG images, read back with checks, and hashed by low frequencies.

A payload of bytes becomes the 8-bit samples of an image 192 samples wide. The encoder picks a filter for every row and
deflates the rows; the decoder tests the signature and every chunk's checksum, inflates, and undoes all five filters
with numpy. The feature is the sign pattern of the low frequencies of a two-dimensional cosine transform.

Cases: a null text counts as empty; an empty payload is padded to one row of 192 blanks; equal texts give equal values;
an empty table gives an empty table; other columns of the input are never looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, quoted

WIDTH = 192
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREYSCALE = 0


def padded(raw: bytes) -> bytes:
    """raw and blanks up to a positive multiple of the image's width."""
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A greyscale PNG of width samples a row; each row takes whichever of the filters none, sub and up has the smallest sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (rows, sub, up)]
    kind = np.argmin(cost, axis=0).astype(np.uint8)
    body = np.choose(kind[:, None], (rows, sub, up))
    lines = np.hstack([kind[:, None], body])
    head = struct.pack(">IIBBBBB", width, len(rows), 8, GREYSCALE, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(image: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not image.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at = len(SIGNATURE)
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data, check = image[at + 8 : at + 8 + size], image[at + 8 + size : at + 12 + size]
        if len(check) != 4 or zlib.crc32(kind + data) != int.from_bytes(check, "big"):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        yield kind, data
        at += 12 + size


def _paeth(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    left = corner = 0
    out = np.empty_like(line)
    for k, (x, b) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        guess = left + b - corner
        _, _, best = min((abs(guess - left), 0, left), (abs(guess - b), 1, b), (abs(guess - corner), 2, corner))
        left, corner = (x + best) & 255, b
        out[k] = left
    return out


def _average(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    left, out = 0, np.empty_like(line)
    for k, (x, b) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        out[k] = left = (x + (left + b) // 2) & 255
    return out


def samples(image: bytes) -> np.ndarray:
    """The rows of a non-interlaced 8-bit greyscale PNG; raises ValueError where a check fails."""
    parts = list(_chunks(image))
    if not parts or parts[0][0] != b"IHDR" or parts[-1][0] != b"IEND":
        raise ValueError("chunks are missing")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if (depth, colour, interlace) != (8, GREYSCALE, 0):
        raise ValueError("only 8-bit greyscale without interlacing is read")
    lines = np.frombuffer(zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT")), np.uint8).reshape(height, width + 1)
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    sub = kinds == 1
    out[sub] = np.add.accumulate(out[sub], axis=1, dtype=np.uint8)
    above = np.zeros(width, np.uint8)
    for k in np.flatnonzero(kinds > 1):  # these rows need the finished row above
        above = out[k - 1] if k else np.zeros(width, np.uint8)
        if kinds[k] == 2:
            out[k] += above
        else:
            out[k] = (_average if kinds[k] == 3 else _paeth)(out[k], above)
    return out


@cache
def _cosines(side: int, keep: int) -> np.ndarray:
    return np.cos(np.pi / side * (np.arange(side) + 0.5) * np.arange(keep)[:, None])


def low_frequency_hash(rows: np.ndarray, side: int = 32, keep: int = 8) -> str:
    """64 bits as 16 hex digits: which of the 8 x 8 lowest frequencies of the image, shrunk to 32 x 32, exceed their median."""
    tall = rows if len(rows) >= side else rows[np.arange(side) * len(rows) // side]
    means = np.add.reduceat(tall, np.arange(side) * len(tall) // side, axis=0, dtype=np.int64)
    means = np.add.reduceat(means, np.arange(side) * rows.shape[1] // side, axis=1)
    sizes = np.diff(np.append(np.arange(side) * len(tall) // side, len(tall)))
    waves = _cosines(side, keep)
    low = np.round(waves @ (means / sizes[:, None]) @ waves.T, 3).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def with_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media: the PNG of every row's whole text."""
    narrow = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raws), pa.int64()), pa.array([png(padded(x)) for x in raws], pa.binary())], [key, "n_bytes", "media"])

    return in_arrow(narrow, store, f"{quoted(key)} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def read_media(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the images of with_media() hold, read back: size and checksums of payload and image, and the feature."""
    kind = stored.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [x.as_py() for x in batch.column(2)]
            rows = [samples(x) for x in images]
            payloads = [x.tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(map(len, payloads), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in payloads], pa.string()),
                    pa.array([zlib.crc32(x[-16:]) for x in payloads], pa.int64()),
                    pa.array(map(len, images), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in images], pa.string()),
                    pa.array([low_frequency_hash(x) for x in rows], pa.string()),
                ],
                [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    narrow = stored.select(F.col(quoted(key)).alias("key"), "n_bytes", "media")
    return in_arrow(narrow, read, f"{quoted(key)} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
