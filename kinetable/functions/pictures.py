"""Pictures held in a column: PNG files of every colour type, depth and line filter to pixels, and Lanczos resizing in fixed point."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PICTURE = "height int, width int, channels int, data binary"
# The first bytes, channels by colour type, and the seven passes of interlaced files (x, y, steps).
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
LOBES, BITS = 3, 22


class Broken(ValueError):
    pass


def chunks(data: bytes):
    """(kind, body) of a file's chunks up to its end, each held against its checksum."""
    if data[:8] != PNG:
        raise Broken("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise Broken("a broken chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise Broken("no end")


def unfiltered(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Lines of bytes without their filters; ``step`` bytes are a pixel.

    Without averages and Paeth lines each line is a sum; with them pixels are taken by diagonals, as each needs those to its left and above.
    """
    high, wide = lines.shape
    if kinds.max(initial=0) > 4:
        raise Broken("an unknown filter")
    if kinds.max(initial=0) < 3:
        out = lines.copy()
        for y in np.flatnonzero(kinds).tolist():
            if kinds[y] == 1:
                out[y] = np.cumsum(out[y].reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
            elif y:
                out[y] += out[y - 1]
        return out
    across = wide // step
    raw = lines.reshape(high, across, step).astype(np.int16)
    out = np.zeros((high + 1, across + 1, step), np.int16)
    for d in range(high + across - 1):
        y = np.arange(max(0, d - across + 1), min(high, d + 1))
        x = d - y
        left, up, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y][:, None]
        p, q, r = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((p <= q) & (p <= r), left, np.where(q <= r, up, corner))
        out[y + 1, x + 1] = raw[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0) & 255
    return out[1:, 1:].astype(np.uint8).reshape(high, wide)


def _samples(data: bytes, at: int, high: int, wide: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """[line, column, channel] of one pass, eight bits or, of a palette or fewer bits, as they are; and where the next begins."""
    line = -(-wide * depth * channels // 8)
    if at + high * (line + 1) > len(data):
        raise Broken("too few lines")
    raw = np.frombuffer(data, np.uint8, high * (line + 1), at).reshape(high, line + 1)
    out = unfiltered(raw[:, 1:], raw[:, 0], max(depth * channels // 8, 1))
    if depth == 16:
        out = out[:, ::2]  # the upper byte
    elif depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(high, -1, depth)
        out = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, : wide * channels]
    return out.reshape(high, wide, channels), at + high * (line + 1)


def decode_png(data: bytes) -> np.ndarray:
    """[line, column, (blue, green, red)] of a PNG file; alpha is left out, of 16 bits the upper eight count."""
    head = palette = None
    packed = []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[3] not in CHANNELS or not head[0] or not head[1]:
        raise Broken("no header")
    wide, high, depth, colour, _, _, interlaced = head
    channels = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise Broken(str(e)) from e
    if interlaced:
        a, at = np.zeros((high, wide, channels), np.uint8), 0
        for x, y, dx, dy in PASSES:
            h, w = -(-(high - y) // dy), -(-(wide - x) // dx)
            if h > 0 and w > 0:
                a[y::dy, x::dx], at = _samples(raw, at, h, w, depth, channels)
    else:
        a, _ = _samples(raw, 0, high, wide, depth, channels)
    if colour == 3:
        if palette is None or a.max() >= len(palette):
            raise Broken("no such colour")
        return np.ascontiguousarray(palette[a[:, :, 0]][:, :, ::-1])
    if depth < 8:
        a = a * np.uint8(255 // ((1 << depth) - 1))
    return np.repeat(a[:, :, :1], 3, 2) if channels < 3 else np.ascontiguousarray(a[:, :, 2::-1])


@lru_cache(256)
def lanczos_taps(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``to`` places the samples it takes of ``size`` and their weights in fixed point, [place, tap].

    The kernel is a sinc under the window of a wider sinc, three lobes to a side, stretched by the ratio where the picture shrinks.
    """
    ratio = size / to
    stretch = max(ratio, 1.0)
    centre = (np.arange(to) + 0.5) * ratio
    first = np.maximum((centre - LOBES * stretch + 0.5).astype(int), 0)
    last = np.minimum((centre + LOBES * stretch + 0.5).astype(int), size)
    at = first[:, None] + np.arange(int((last - first).max()))
    x = (at - centre[:, None] + 0.5) / stretch
    weight = np.where((at < last[:, None]) & (np.abs(x) < LOBES), np.sinc(x) * np.sinc(x / LOBES), 0.0)
    weight /= weight.sum(1, keepdims=True)
    return np.minimum(at, size - 1), np.trunc(weight * (1 << BITS) + np.copysign(0.5, weight)).astype(np.int64)


def _along(a: np.ndarray, to: int) -> np.ndarray:
    """The first axis resized."""
    at, weight = lanczos_taps(a.shape[0], to)
    total = np.full((to, *a.shape[1:]), 1 << (BITS - 1), np.int64)
    for k in range(at.shape[1]):
        total += a[at[:, k]] * weight[:, k].reshape(-1, *[1] * (a.ndim - 1))
    return np.clip(total >> BITS, 0, 255).astype(np.uint8)


def lanczos(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """The picture [line, column, ...] at another size, columns first; a side that fits is left as it is."""
    if a.shape[1] != width:
        a = np.swapaxes(_along(np.swapaxes(a, 0, 1), width), 0, 1)
    return _along(a, height) if a.shape[0] != height else a


def png_size(content: Column) -> Column:
    """(width, height) from a PNG file's head, null for other files; nothing else is read."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.substring(content, 1, 8) == F.lit(PNG), F.struct(number(17).alias("width"), number(21).alias("height")))


def decoded(content: Column) -> Column:
    """(height, width, channels, data) of a column of PNG files, blue, green and red; null where a file is broken or of another kind."""

    @F.pandas_udf(PICTURE)
    def run(files: pd.Series) -> pd.DataFrame:
        rows = []
        for b in files:
            try:
                a = None if b is None else decode_png(b)
            except (Broken, struct.error):
                a = None
            rows.append((None,) * 4 if a is None else (*a.shape, a.tobytes()))
        return pd.DataFrame(rows, columns=["height", "width", "channels", "data"])

    got = run(content)
    return F.when(got["data"].isNotNull(), got)
