"""PNG files of every kind, and Lanczos resizing, against plain versions."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import pictures
from kinetable.operators import raster


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(line, above, step, kind):
    """A line as a writer filters it."""
    out = bytearray()
    for k, x in enumerate(line):
        left, up, corner = line[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
        p = left + up - corner
        near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        out.append((x - (0, left, up, (left + up) // 2, near)[kind]) % 256)
    return bytes([kind]) + bytes(out)


def packed(samples, depth):
    """Samples of a line as bytes."""
    if depth == 16:
        return b"".join(struct.pack(">H", int(s)) for s in samples)
    if depth == 8:
        return bytes(int(s) for s in samples)
    bits = "".join(format(int(s), f"0{depth}b") for s in samples)
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def lines_of(a, depth, step, kinds):
    above, out = None, b""
    for y in range(a.shape[0]):
        line = packed(a[y].reshape(-1), depth)
        out += filtered(line, above or bytes(len(line)), step, kinds(y))
        above = line
    return out


def file_of(a, depth, colour, kinds, interlaced=False, palette=None, parts=3):
    step = max(depth * a.shape[2] // 8, 1)
    if interlaced:
        raw = b"".join(lines_of(a[y::dy, x::dx], depth, step, kinds) for x, y, dx, dy in pictures.PASSES if a[y::dy, x::dx].size)
    else:
        raw = lines_of(a, depth, step, kinds)
    z = zlib.compress(raw)
    cut = [z[k * len(z) // parts : (k + 1) * len(z) // parts] for k in range(parts)]
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, colour, 0, 0, int(interlaced))
    more = [chunk(b"PLTE", palette.astype(np.uint8).tobytes())] if palette is not None else []
    return pictures.PNG + chunk(b"IHDR", head) + chunk(b"tEXt", b"k\0v") + b"".join(more) + b"".join(chunk(b"IDAT", c) for c in cut) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("colour,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_every_kind_of_file(colour, depth, interlaced):
    rng = np.random.default_rng(colour * 100 + depth)
    for h, w in ((1, 1), (5, 7), (9, 3), (13, 18)):
        a = rng.integers(0, 1 << depth, (h, w, pictures.CHANNELS[colour]))
        palette = rng.integers(0, 256, (1 << depth, 3)) if colour == 3 else None
        if colour == 3:
            want = palette[a[:, :, 0]][:, :, ::-1]
        else:
            eight = a >> 8 if depth == 16 else a * 255 // ((1 << depth) - 1)
            want = np.repeat(eight[:, :, :1], 3, 2) if colour in (0, 4) else eight[:, :, 2::-1]
        for kinds in (lambda y: y % 5, lambda y: (0, 1, 2)[y % 3], lambda y: 4):
            assert (pictures.decode_png(file_of(a, depth, colour, kinds, interlaced, palette)) == want).all()


def test_round_trip_and_broken_files(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (6, 11, 3), dtype=np.uint8)
    whole = raster.png(a)
    assert (pictures.decode_png(whole) == a).all()
    flipped = whole[:50] + bytes([whole[50] ^ 1]) + whole[51:]
    filters = file_of(rng.integers(0, 256, (3, 3, 3)), 8, 2, lambda y: 0)
    rows = [(0, whole), (1, None), (2, b""), (3, whole[:-20]), (4, flipped), (5, b"\xff\xd8\xff\xe0 another kind"), (6, filters)]
    got = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in rows], "k int, png binary").select("k", pictures.decoded(F.col("png")).alias("p"), pictures.png_size(F.col("png")).alias("s"))
    by = {r["k"]: r for r in got.collect()}
    assert (by[0]["p"]["height"], by[0]["p"]["width"], by[0]["p"]["channels"], bytes(by[0]["p"]["data"])) == (6, 11, 3, a.tobytes())
    assert [k for k in by if by[k]["p"] is not None] == [0, 6] and tuple(by[0]["s"]) == (11, 6)
    assert by[5]["s"] is None and by[1]["s"] is None and by[2]["s"] is None


def plain_lanczos(line, to):
    """One line of numbers, sample by sample."""
    n, out = len(line), []
    ratio = n / to
    wide = max(ratio, 1)
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    for o in range(to):
        c = (o + 0.5) * ratio
        places = range(max(int(c - 3 * wide + 0.5), 0), min(int(c + 3 * wide + 0.5), n))
        w = [sinc((i + 0.5 - c) / wide) * sinc((i + 0.5 - c) / wide / 3) if abs((i + 0.5 - c) / wide) < 3 else 0.0 for i in places]
        fixed = [int(x / sum(w) * 2**22 + math.copysign(0.5, x)) for x in w]
        out.append(min(max((sum(f * int(line[i]) for f, i in zip(fixed, places, strict=True)) + 2**21) >> 22, 0), 255))
    return out


@pytest.mark.parametrize("size,to", [((9, 14), (4, 5)), ((9, 14), (20, 31)), ((1, 1), (3, 2)), ((40, 3), (2, 3)), ((5, 5), (5, 5))])
def test_lanczos(size, to):
    rng = np.random.default_rng(size[0])
    a = rng.integers(0, 256, (*size, 3), dtype=np.uint8)
    across = np.stack([np.array([plain_lanczos(a[y, :, c], to[1]) for y in range(size[0])]) for c in range(3)], 2) if size[1] != to[1] else a
    want = np.stack([np.array([plain_lanczos(across[:, x, c], to[0]) for x in range(to[1])]).T for c in range(3)], 2) if size[0] != to[0] else across
    assert (pictures.lanczos(a, *to) == want).all()


def test_lanczos_does_not_alias():
    """Lines a pixel wide become even grey, an even picture stays as it is, weights sum to one."""
    lines = np.repeat(np.arange(120) % 2 * 255, 40).reshape(120, 40, 1).astype(np.uint8)
    inner = pictures.lanczos(lines, 15, 40)[2:-2].astype(int)
    assert inner.max() - inner.min() < 20 and abs(inner.mean() - 127.5) < 2
    assert (pictures.lanczos(np.full((50, 70, 3), 91, np.uint8), 17, 23) == 91).all()
    assert all(abs(pictures.lanczos_taps(n, m)[1].sum(1) - (1 << 22)).max() < 40 for n, m in ((1000, 37), (37, 1000), (8, 8)))
