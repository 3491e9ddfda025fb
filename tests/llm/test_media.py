import hashlib
import struct
import zlib

import numpy as np
import pytest

from braidgraph.llm import png_media as png


@pytest.mark.parametrize("data", [b"", b"x", b"a" * 192, b"b" * 193, bytes(range(256)) * 40, "é😀".encode() * 999])
def test_round_trip(data):
    payload = png.padded(data)
    assert len(payload) % 192 == 0 and payload and payload.startswith(data) and not payload[len(data) :].strip(b" ")
    assert png.read_png(png.write_png(payload)).tobytes() == payload


def filtered(pixels, kind, bpp):
    rows = pixels.reshape(len(pixels), -1).astype(int)
    out = bytearray()
    for y, row in enumerate(rows):
        f = kind(y)
        out.append(f)
        for x, v in enumerate(row):
            a = row[x - bpp] if x >= bpp else 0
            b = rows[y - 1][x] if y else 0
            c = rows[y - 1][x - bpp] if y and x >= bpp else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, paeth)[f]) & 255)
    return bytes(out)


@pytest.mark.parametrize("colour,bpp", [(0, 1), (2, 3), (6, 4)])
@pytest.mark.parametrize("kind", [lambda y: 0, lambda y: 1, lambda y: 2, lambda y: 3, lambda y: 4, lambda y: y % 5, lambda y: (y * 7 // 3) % 5])
def test_all_filters(colour, bpp, kind):
    pixels = np.random.default_rng(bpp).integers(0, 256, (13, 9, bpp)).astype(np.uint8)
    raw = zlib.compress(filtered(pixels, kind, bpp))
    image = png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 13, 8, colour, 0, 0, 0)) + png.chunk(b"tEXt", b"note") + png.chunk(b"IDAT", raw[:11]) + png.chunk(b"IDAT", raw[11:]) + png.chunk(b"IEND", b"")
    assert (png.read_png(image) == pixels).all()


def test_damage_is_noticed():
    image = png.write_png(png.padded(b"some bytes" * 50))
    for at in range(len(image)):
        bad = bytearray(image)
        bad[at] ^= 1
        with pytest.raises(png.BadImage):
            png.read_png(bytes(bad))
    for n in range(len(image)):
        with pytest.raises(png.BadImage):
            png.read_png(image[:n])


def image_of(head, data=b"\0" * 10):
    return png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"IDAT", zlib.compress(data)) + png.chunk(b"IEND", b"")


def test_images_that_promise_too_much(spark):
    good = struct.pack(">IIBBBBB", 3, 1, 8, 2, 0, 0, 0)
    assert png.read_png(image_of(good)).shape == (1, 3, 3)
    bad = [good[:12], good + b"x", b""] + [struct.pack(">IIBBBBB", *x) for x in ((3, 0, 8, 2, 0, 0, 0), (0, 1, 8, 2, 0, 0, 0), (3, 1, 8, 2, 1, 0, 0), (3, 1, 8, 2, 0, 1, 0), (3, 1, 8, 2, 0, 0, 1), (3, 2, 8, 2, 0, 0, 0), (2, 1, 8, 2, 0, 0, 0), (3, 1, 16, 2, 0, 0, 0))]
    images = [image_of(h) for h in bad] + [image_of(good, b"\0" * 50_000_000)]
    rows = png.features(spark.createDataFrame(list(enumerate(images)), "i int, image binary"), ["i"]).collect()
    assert len(rows) == len(images) and all(r.problem and r.feature is None for r in rows)


def plain_hash(pixels):
    """The feature by its definition, with loops."""
    import math

    grey = [[(299 * r + 587 * g + 114 * b) // 1000 for r, g, b in row] for row in pixels.tolist()]

    def shrink(rows):
        out = []
        for i in range(32):
            a, b = i * len(rows) // 32, (i + 1) * len(rows) // 32
            part = rows[a:b] if len(rows) >= 32 else [rows[a]]
            out.append([sum(x) * 256 // len(part) for x in zip(*part, strict=True)])
        return out

    turn = lambda m: [list(x) for x in zip(*m, strict=True)]
    small = [[v // 256 for v in row] for row in turn(shrink(turn(shrink(grey))))]
    base = [[round(4096 * math.cos(math.pi * u * (2 * x + 1) / 64)) for x in range(32)] for u in range(8)]
    low = [sum(base[u][y] * base[v][x] * small[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join('1' if v > middle else '0' for v in low), 2):016x}"


@pytest.mark.parametrize("rows", [1, 7, 31, 32, 33, 100])
def test_hash_by_definition(rows):
    pixels = np.random.default_rng(rows).integers(0, 256, (rows, 64, 3)).astype(np.uint8)
    assert png.cosine_hash(pixels) == plain_hash(pixels)


def test_hash():
    a = np.random.default_rng(1).integers(0, 256, (40, 64, 3)).astype(np.uint8)
    b = a.copy()
    b[3, 4] ^= 1
    c = np.random.default_rng(2).integers(0, 256, (40, 64, 3)).astype(np.uint8)
    far = lambda x, y: (int(png.cosine_hash(x), 16) ^ int(png.cosine_hash(y), 16)).bit_count()
    assert far(a, b) <= 4 < 16 < far(a, c)
    assert len(png.cosine_hash(a[:1])) == 16


def test_documents(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in png.media_digests(documents).collect():
        data = png.padded(texts[r.doc_id].encode())
        image = png.write_png(data)
        assert tuple(r)[1:] == (len(texts[r.doc_id].encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(image), hashlib.sha256(image).hexdigest(), png.cosine_hash(png.read_png(image)))


def test_odd(spark, odd, none):
    rows = {r.doc_id: tuple(r)[1:] for r in png.media_digests(odd).collect()}
    assert rows[2] == rows[3] and rows[2][:2] == (0, 192) and rows[1] == rows[9] and rows[4][0] == 150_000
    assert png.media_digests(none).count() == 0
    bad = spark.createDataFrame([(1, None), (2, b"nope")], "i int, image binary")
    assert {r.i: r.problem for r in png.features(bad, ["i"]).collect()} == {1: "null", 2: "no PNG signature"}
