"""Media columns: byte payloads as PNG pictures in binary columns, read back and hashed.

encode: a payload becomes an 8-bit grey picture of 64 columns; its rows are filtered (type 0, or
2 where a row repeats the one above), deflated and framed as PNG chunks with CRC-32. decode walks
the chunks, tests the signature, every CRC, the header and the Adler sum that zlib holds, and undoes
all five PNG filters with numpy. picture_hash: 64 bits, the signs of the 8 x 8 lowest cosine-transform
coefficients against their median (without the constant one), from the whole picture.

Defined cases: null and repeated doc_ids and repeated rows are kept, row by row; an empty table gives an empty
result; columns beside doc_id and text are never read, so their names can't clash; a null payload or text is the empty one; empty payloads are padded to one row; a
picture that fails a test raises MediaError; very long texts give more rows and are never cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Fixed by the PNG specification.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


class MediaError(ValueError):
    pass


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """Bytes 0 up to a positive multiple of unit."""
    size = max(unit, -(-len(data) // unit) * unit)
    return data + bytes(size - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = np.zeros((len(rows), width + 1), np.uint8)
    out[:, 1:] = rows
    same = np.flatnonzero((rows[1:] == rows[:-1]).all(axis=1)) + 1
    out[same, 0] = 2
    out[same, 1:] = 0
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(out.tobytes(), 6)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown filter")
    for y in np.flatnonzero(kinds):
        kind, row = kinds[y], out[y]
        up = out[y - 1] if y else np.zeros_like(row)
        if kind == 1:
            out[y] = np.cumsum(row, dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            out[y] = row + up
        else:
            left, corner = 0, 0
            for x in range(len(row)):
                above = int(up[x])
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((left, above, corner), key=lambda v: abs(p - v))
                left = (int(row[x]) + guess) & 255
                corner = above
                out[y, x] = left
    return out


def decode_png(data: bytes) -> np.ndarray:
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, size, ended, inflate, raw = 8, None, False, zlib.decompressobj(), bytearray()
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("cut chunk")
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + length], data[at + 8 + length : at + 12 + length]
        if len(body) != length or check != struct.pack(">I", zlib.crc32(kind + body)):
            raise MediaError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            *size, depth, colour, packing, filters, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, packing, filters, interlace) != (8, 0, 0, 0, 0):
                raise MediaError("only 8-bit grey pictures without interlace")
        elif kind == b"IDAT":
            raw += inflate.decompress(body)
        ended = kind == b"IEND"
        at += 12 + length
    if not (size and ended and inflate.eof):
        raise MediaError("cut picture")
    width, height = size
    if len(raw) != height * (width + 1):
        raise MediaError("wrong number of samples")
    return _unfilter(np.frombuffer(bytes(raw), np.uint8).reshape(height, width + 1))


def _cosines(n: int, k: int = 8) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5) * np.arange(k)[:, None] / n)


_kept = lru_cache(maxsize=128)(_cosines)


def _basis(n: int) -> np.ndarray:
    """Only short ones are kept, so that what is kept stays under 17 MB whatever the texts."""
    return _kept(n) if n <= 2048 else _cosines(n)


def picture_hash(picture: np.ndarray) -> str:
    low = (_basis(picture.shape[0]) @ picture.astype(np.float64)) @ _basis(picture.shape[1]).T
    flat = np.round(low / picture.size, 9).ravel()
    bits = flat > np.median(flat[1:])
    return np.packbits(bits).tobytes().hex()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media, sizes = [], []
        for x in b["payload"]:
            data = x.as_py() or b""
            sizes.append(len(data))
            media.append(encode_png(pad(data)))
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def encode_column(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(doc_id, payload binary) -> doc_id, n_bytes, media (PNG)."""
    return df.select("doc_id", F.col(payload).alias("payload")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for x in b["media"]:
            stored = x.as_py()
            picture = decode_png(stored)
            payload = picture.tobytes()
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), picture_hash(picture))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> digests and features of what decoding gives back."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _decode,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def text_media(docs: DataFrame) -> DataFrame:
    return encode_column(docs.select("doc_id", F.encode(text_of("text"), "UTF-8").alias("payload")))
