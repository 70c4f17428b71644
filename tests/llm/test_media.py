import hashlib
import math
import statistics
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.llm import media

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "é" * 500, "abc\n" * 60_000, "a" * 640, "\x00\x00"]


def test_round_trip(spark, docs):
    rows = list(enumerate(TEXTS)) + [(None, "n"), (2, "a")]
    got = media.media_features(media.text_media(docs(rows, extra=["media", "payload"]))).collect()
    assert len(got) == len(rows)
    same = {}
    for r in got:
        data = ("n" if r["doc_id"] is None else TEXTS[r["doc_id"]] or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert same.setdefault(data, r[3:]) == r[3:] and len(r["feature"]) == 16


def test_empty(spark, docs):
    assert media.media_features(media.text_media(docs([]))).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000))
def test_png(data):
    padded = media.pad(data)
    assert media.decode_png(media.encode_png(padded)).tobytes() == padded


def filtered(rows, kinds):
    """PNG filters by their definition, byte by byte."""
    out = bytearray()
    for y, row in enumerate(rows):
        out.append(kinds[y])
        for x, v in enumerate(row):
            a = int(row[x - 1]) if x else 0
            b = int(rows[y - 1][x]) if y else 0
            c = int(rows[y - 1][x - 1]) if x and y else 0
            nearest = sorted(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[0][2]
            out.append((int(v) - (0, a, b, (a + b) // 2, nearest)[kinds[y]]) % 256)
    return bytes(out)


def picture(rows, kinds, parts=1):
    data = zlib.compress(filtered(rows, kinds))
    step = -(-len(data) // parts)
    chunks = b"".join(media._chunk(b"IDAT", data[i : i + step]) for i in range(0, len(data), step))
    return media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + media._chunk(b"tEXt", b"k\0v") + chunks + media._chunk(b"IEND", b"")


def test_all_filters_and_split_data():
    rows = np.random.default_rng(0).integers(0, 256, (10, 17), dtype=np.uint8)
    assert (media.decode_png(picture(rows, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0], parts=5)) == rows).all()


@pytest.mark.parametrize("at", [3, 20, 45, -3, None])
def test_damage_is_found(at):
    data = bytearray(media.encode_png(media.pad(b"some text to store" * 9)))
    if at is None:
        data = data[: len(data) // 2]
    else:
        data[at] ^= 1
    with pytest.raises((media.MediaError, zlib.error)):
        media.decode_png(bytes(data))


def test_hash_is_near_for_near_pictures():
    rng = np.random.default_rng(1)
    smooth = np.add.outer(np.linspace(0, 90, 64), 80 * np.sin(np.linspace(0, 7, 64))).clip(0, 255)
    a, b = (int(media.picture_hash((smooth + rng.normal(0, 1, smooth.shape)).clip(0, 255).astype(np.uint8)), 16) for _ in range(2))
    c = int(media.picture_hash(rng.integers(0, 256, (64, 64), dtype=np.uint8)), 16)
    assert (a ^ b).bit_count() <= 8 and (a ^ c).bit_count() >= 16


def slow_hash(picture):
    """Bit 8 u + v is 1 if the cosine sum of row frequency u and column frequency v is over the median of all but the first."""
    height, width = picture.shape
    sums = []
    for u in range(8):
        for v in range(8):
            total = sum(int(picture[y, x]) * math.cos(math.pi * (y + 0.5) * u / height) * math.cos(math.pi * (x + 0.5) * v / width) for y in range(height) for x in range(width))
            sums.append(round(total / (height * width), 9))
    middle = statistics.median(sums[1:])
    return f"{int(''.join(str(int(s > middle)) for s in sums), 2):016x}"


@pytest.mark.parametrize("shape", [(1, 64), (3, 64), (64, 64), (20, 7)])
def test_hash_by_brute_force(shape):
    assert media.picture_hash(picture := np.random.default_rng(sum(shape)).integers(0, 256, shape, dtype=np.uint8)) == slow_hash(picture)


def test_long_pictures_are_hashed_alike():
    tall = np.random.default_rng(3).integers(0, 256, (2049, 1), dtype=np.uint8)
    assert media.picture_hash(tall) == slow_hash(tall)
