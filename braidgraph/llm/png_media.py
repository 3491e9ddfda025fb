"""Bytes as PNG images in a binary column: written losslessly, read back with checksum tests, and hashed by low frequencies.

A payload becomes 8-bit RGB rows of 64 pixels. Writing picks a filter per row (none, sub or up) by the smallest sum of
absolute differences; reading checks the signature, every chunk's CRC and the zlib stream's own checksum, and undoes all
five filters in numpy. The feature is a 64-bit hash: the signs, against their median, of the lowest 8 x 8 cosine
frequencies of the 32 x 32 grey image, in whole numbers, so that equal images have equal hashes on every machine.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._common import ready

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
#: Pixels of the grey image's side, and of the kept frequencies'.
SIDE, LOW = 32, 8


class BadImage(ValueError):
    """The stored bytes are no image that this reader can vouch for."""


def padded(data: bytes) -> bytes:
    """data and as many blanks (byte 32) as make it a positive multiple of a row."""
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW, b" ")


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, level: int = 6) -> bytes:
    """The payload, a positive multiple of 192 bytes, as an RGB image of 64 pixels a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub = rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up = rows.copy()
    up[1:] -= rows[:-1]
    kinds = np.stack([rows, sub, up])
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(2)
    best = cost.argmin(0)
    out = np.empty((len(rows), ROW + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = kinds[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + chunk(b"IEND", b"")


def read_png(image: bytes) -> np.ndarray:
    """Rows x width x channels of an 8-bit grey, RGB or RGBA image without interlacing; BadImage if any test fails."""
    if image[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(image) and not ended:
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + n]
        if len(data) < n or image[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise BadImage(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            if n != 13:
                raise BadImage("size of the header")
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise BadImage("header or end is missing")
    width, height, depth, colour, packing, filters, lace = head
    if not width or not height:
        raise BadImage("no pixels")
    if depth != 8 or colour not in (0, 2, 6) or packing or filters or lace:
        raise BadImage("only plain 8-bit grey, RGB and RGBA")
    bpp = {0: 1, 2: 3, 6: 4}[colour]
    size, stream = height * (width * bpp + 1), zlib.decompressobj()
    try:  # never more than the header promises, and a byte to see that there is more
        raw = stream.decompress(b"".join(body), size + 1)
    except zlib.error as e:
        raise BadImage(str(e)) from None
    if len(raw) != size or not stream.eof:
        raise BadImage("size of the image data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width * bpp + 1)
    return unfiltered(lines[:, 0], lines[:, 1:], bpp).reshape(height, width, bpp)


def unfiltered(kind: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Samples from filtered rows; runs of equal filters are undone together where they allow it."""
    if (kind > 4).any():
        raise BadImage("unknown filter")
    out = rows.copy()
    cut = np.concatenate([np.flatnonzero(np.diff(kind, prepend=255)), [len(kind)]])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        f = kind[a]
        if f == 1:  # every pixel adds the one on its left: running sums modulo 256
            out[a:b] = np.add.accumulate(out[a:b].reshape(b - a, -1, bpp), axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif f == 2:  # every row adds the one above
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.add.accumulate(out[a:b], axis=0, dtype=np.uint8)
        elif f > 2:
            for y in range(a, b):
                above = out[y - 1].astype(np.int16) if y else np.zeros(out.shape[1], np.int16)
                line = out[y].reshape(-1, bpp)
                up = above.reshape(-1, bpp)
                left, corner = np.zeros(bpp, np.int16), np.zeros(bpp, np.int16)
                for x in range(len(line)):
                    if f == 3:
                        guess = (left + up[x]) >> 1
                    else:
                        p = left + up[x] - corner
                        pa_, pb, pc = np.abs(p - left), np.abs(p - up[x]), np.abs(p - corner)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up[x], corner))
                    line[x] = (line[x] + guess) & 255
                    left, corner = line[x].astype(np.int16), up[x]
    return out


#: Rows of the cosine transform, rounded to whole numbers.
BASIS = np.rint(4096 * np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))).astype(np.int64)


def shrunk(x: np.ndarray, n: int) -> np.ndarray:
    """Sums over n nearly equal runs of rows, scaled to 256 times the mean; fewer rows than n are repeated."""
    cut = np.arange(n + 1) * len(x) // n
    if len(x) < n:
        return x[cut[:-1]] * 256
    total = np.concatenate([np.zeros((1, *x.shape[1:]), np.int64), np.cumsum(x, axis=0)])
    size = np.diff(cut).reshape(-1, *[1] * (x.ndim - 1))
    return (total[cut[1:]] - total[cut[:-1]]) * 256 // size


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hexadecimal digits: which low frequencies exceed their median."""
    p = pixels.astype(np.int64)
    grey = (299 * p[..., 0] + 587 * p[..., 1] + 114 * p[..., 2]) // 1000 if p.shape[2] >= 3 else p[..., 0]
    small = shrunk(shrunk(grey, SIDE).T, SIDE).T // 256
    low = (BASIS @ small @ BASIS.T).ravel()
    bits = low > np.sort(low[1:])[31]
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def media(docs: DataFrame, keep: list[str], level: int = 6) -> DataFrame:
    """Columns keep, n_bytes (of the text) and image (its PNG). Null texts count as empty: one row of blanks."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [(t or "").encode() for t in b.column("text").to_pylist()]
            image = [write_png(padded(d), level) for d in data]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(map(len, data), pa.int64()), pa.array(image, pa.binary())], names=[*keep, "n_bytes", "image"])

    schema = StructType([StructField(k, docs.schema[k].dataType) for k in keep]).add("n_bytes", "long").add("image", "binary")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def features(images: DataFrame, keep: list[str]) -> DataFrame:
    """Columns keep, payload_bytes, payload_sha256, tail_crc32, feature, problem of the column image.

    An image that fails a test has its reason in problem and null elsewhere; null images have the problem 'null'.
    """
    ready(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for image in b.column("image").to_pylist():
                try:
                    if image is None:
                        raise BadImage("null")
                    pixels = read_png(image)
                    data = pixels.tobytes()
                    row = [len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), cosine_hash(pixels), None]
                except BadImage as e:
                    row = [None, None, None, None, str(e)]
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=[*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature", "problem"])

    schema = StructType([StructField(k, images.schema[k].dataType) for k in keep]).add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("feature", "string").add("problem", "string")
    return images.select(*keep, "image").mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document.

    Null texts count as empty: one row of blanks. Very long texts are stored whole, in one image of as many rows as they
    take. Frequencies equal to the median count as low. Repeated rows get a row each with equal values; extra columns are
    ignored; no rows give no rows.
    """
    stored = media(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", "n_bytes", F.length("image").cast("long").alias("media_bytes"), F.sha2("image", 256).alias("media_sha256"), "image")
    got = features(stored, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
