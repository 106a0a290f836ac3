"""Baseline JPEG in numpy: a lossless byte carrier, a marker parser and a DC-only thumbnail reader.

A payload becomes a grey picture whose 8x8 blocks are flat, one block a byte: with a DC quantiser of
8 the DC coefficient is the byte less 128, so the DC-only thumbnail is the payload itself.  Each row
of blocks is one restart interval; readers decode all intervals in lockstep, one Huffman symbol of
every interval a step.  Pictures by other writers (colour, subsampling, AC coefficients, no restart
markers) are read by the same code.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

ROW = 192
MOST_BLOCKS = 8191
#: A marker that is neither a stuffed byte nor a restart nor fill.
AFTER_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")

# Fixed values of the JPEG standard: the luminance DC table (K.3) and the zigzag-free DC size limit.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
AC_COUNTS = [1] + [0] * 15
AC_SYMBOLS = [0]


def huffman_codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), canonical."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16 bits ahead: symbol * 32 + code length; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in huffman_codes(counts, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
    return table


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block whose DC differs by -255..255: size, magnitude, end of block."""
    codes = huffman_codes(DC_COUNTS, DC_SYMBOLS)
    bits, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        bits[d + 255] = (code << size | (d if d >= 0 else d + (1 << size) - 1)) << 1
        length[d + 255] = n + size + 1
    return bits, length


BITS, LENGTH = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(wide: int, high: int) -> bytes:
    """Everything before the scan of a grey picture of ``wide`` x ``high`` blocks."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0)),
        _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
        _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
        _segment(0xDD, struct.pack(">H", wide)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def encode(payloads: list[bytes]) -> list[bytes]:
    """One JPEG stream for each payload, whose size is a positive multiple of 192.

    A payload beyond 192 x 8191 bytes takes several pictures, one after another.
    """
    pieces, owner = [], []
    for i, p in enumerate(payloads):
        for a in range(0, len(p), ROW * MOST_BLOCKS):
            pieces.append(p[a : a + ROW * MOST_BLOCKS])
            owner.append(i)
    if not pieces:
        return []
    rows = np.array([len(p) // ROW for p in pieces])
    level = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, ROW).astype(np.int16) - 128
    diff = level.copy()
    diff[:, 1:] -= level[:, :-1]
    diff += 255
    length = LENGTH.take(diff)
    ends = np.cumsum(length, axis=1)
    size = (ends[:, -1] + 7) >> 3
    begin = np.concatenate([[0], np.cumsum(size)])
    at = (ends - length + 8 * begin[:-1, None]).ravel()
    value = BITS.take(diff).ravel() << (24 - length.ravel() - (at & 7))
    byte = at >> 3
    total = int(begin[-1])
    raw = np.zeros(total + 2, np.int64)
    first = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
    here = byte[first]  # symbols that begin in one byte share its three byte window and never overlap
    window = np.add.reduceat(value, first)
    raw[here] += window >> 16
    raw[here + 1] += window >> 8 & 255
    raw[here + 2] += window & 255
    raw = raw[:total].astype(np.uint8)
    raw[begin[1:] - 1] |= ((1 << (8 * size - ends[:, -1])) - 1).astype(np.uint8)
    full = raw == 255
    before = np.cumsum(full) - full
    to = np.arange(total) + before + 2 * np.repeat(np.arange(len(size)), size)
    out = np.zeros(total + int(full.sum()) + 2 * len(size), np.uint8)
    out[to] = raw
    stop = to[begin[1:] - 1] + full[begin[1:] - 1] + 1
    last = np.cumsum(rows) - 1
    k = np.arange(len(size)) - np.repeat(np.concatenate([[0], last[:-1] + 1]), rows)
    out[stop] = 255
    out[stop + 1] = 0xD0 + k % 8
    out[stop[last] + 1] = 0xD9
    scans, media, cut = out.tobytes(), [b""] * len(payloads), 0
    for i, high, end in zip(owner, rows.tolist(), (stop[last] + 2).tolist(), strict=True):
        media[i] += _header(ROW, high) + scans[cut:end]
        cut = end
    return media


@dataclass
class Component:
    across: int
    down: int
    quantiser: int
    dc: int = 0
    ac: int = 0


@dataclass
class Picture:
    """What the markers of one picture say, and where its scan lies."""

    width: int
    height: int
    components: list[Component]
    tables: dict[int, bytes]
    quantisers: dict[int, int]
    interval: int
    scan: tuple[int, int]

    def shape(self) -> tuple[int, int, int, int]:
        """MCUs across and down, and blocks of the first component in an MCU across and down."""
        if len(self.components) == 1:
            return -(-self.width // 8), -(-self.height // 8), 1, 1
        most = max(c.across for c in self.components), max(c.down for c in self.components)
        first = self.components[0]
        return -(-self.width // (8 * most[0])), -(-self.height // (8 * most[1])), first.across, first.down


def parse(data: bytes) -> list[Picture]:
    """The baseline pictures of a stream; raises ValueError for anything else."""
    out, i = [], 0
    while i < len(data):
        if data[i : i + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        i += 2
        quantisers, tables, interval, frame = {}, {}, 0, None
        while True:
            while data[i : i + 2] == b"\xff\xff":
                i += 1
            if len(data) < i + 4 or data[i] != 0xFF:
                raise ValueError("broken marker")
            marker, size = data[i + 1], struct.unpack(">H", data[i + 2 : i + 4])[0]
            body = data[i + 4 : i + 2 + size]
            i += 2 + size
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quantisers[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                    body = body[1 + 64 * wide :]
            elif marker in (0xC0, 0xC1):
                depth, height, width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8:
                    raise ValueError("not 8 bits")
                parts = [(body[6 + 3 * k], Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k])) for k in range(n)]
                frame = width, height, dict(parts)
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline picture")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = bytes(body[1 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if frame is None or body[0] != len(frame[2]):
                    raise ValueError("not one interleaved scan")
                for k in range(body[0]):
                    c = frame[2][body[1 + 2 * k]]
                    c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                break
        stop = AFTER_SCAN.search(data, i)
        if stop is None:
            raise ValueError("no end of image")
        end = stop.start()
        if data[end + 1] != 0xD9:
            raise ValueError("more than one scan")
        out.append(Picture(frame[0], frame[1], list(frame[2].values()), tables, quantisers, interval, (i, end)))
        i = end + 2
    return out


def _lanes(data: np.ndarray, begin: np.ndarray, mcus: np.ndarray, blocks: list[tuple[int, np.ndarray, np.ndarray]], n_components: int) -> np.ndarray:
    """DC coefficients [lane, MCU, block] of entropy-coded lanes that begin at byte ``begin``."""
    data = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint32)
    ahead = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
    top = len(ahead) - 1
    bit = begin.astype(np.int64) * 8
    lanes = len(begin)
    steps = int(mcus.max(initial=0))
    out = np.zeros((steps, len(blocks), lanes), np.int32)
    last = np.zeros((n_components, lanes), np.int32)
    even = bool((mcus == steps).all())
    for m in range(steps):
        live = slice(None) if even else np.flatnonzero(mcus > m)
        for k, (c, dc, ac) in enumerate(blocks):
            b = bit[live]
            w = ahead[np.minimum(b >> 3, top)] << (b & 7).astype(np.uint32)
            code = dc[w >> np.uint32(16)]
            n, size = code & 31, code >> 5
            if not n.all():
                raise ValueError("no such DC code")
            b = b + n
            w = ahead[np.minimum(b >> 3, top)] << (b & 7).astype(np.uint32)
            v = (w >> np.uint32(1) >> (31 - size).astype(np.uint32)).astype(np.int32)
            v -= np.where(v < (1 << size >> 1), (1 << size) - 1, 0)
            last[c, live] += v
            out[m, k, live] = last[c, live]
            b = b + size
            place = np.ones(len(b), np.int32)
            todo = slice(None)
            while True:
                t = b[todo]
                w = ahead[np.minimum(t >> 3, top)] << (t & 7).astype(np.uint32)
                code = ac[w >> np.uint32(16)]
                n, symbol = code & 31, code >> 5
                if not n.all():
                    raise ValueError("no such AC code")
                b[todo] = t + n + (symbol & 15)
                skip = np.where(symbol == 0, 64, (symbol >> 4) + 1)
                place[todo] += skip.astype(np.int32)
                todo = np.flatnonzero(place < 64)
                if not len(todo):
                    break
            bit[live] = b
    return out.transpose(2, 0, 1)


def thumbnails(streams: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stream its pictures, as width, height and the luminance of each 8x8 block by DC alone."""
    jobs: dict[tuple, list[tuple[int, int, Picture]]] = {}
    found: list[list] = []
    for s, data in enumerate(streams):
        pictures = parse(data)
        found.append([None] * len(pictures))
        for k, p in enumerate(pictures):
            key = (tuple((c.across, c.down, p.tables[c.dc], p.tables[16 + c.ac]) for c in p.components), p.interval)
            jobs.setdefault(key, []).append((s, k, p))
    for (parts, interval), mine in jobs.items():
        single = len(parts) == 1
        blocks = []
        for c, (across, down, dc, ac) in enumerate(parts):
            tables = [_lookup(list(t[:16]), list(t[16:])) for t in (dc, ac)]
            blocks += [(c, *tables)] * (1 if single else across * down)
        raw, begin, mcus, at, base = [], [], [], [], 0
        for s, _, p in mine:
            scan = np.frombuffer(streams[s], np.uint8, p.scan[1] - p.scan[0], p.scan[0])
            full = np.flatnonzero(scan[:-1] == 255)
            stuffed = full[scan[full + 1] == 0] + 1
            marks = full[(scan[full + 1] & 0xF8) == 0xD0]
            drop = np.sort(np.concatenate([stuffed, marks, marks + 1]))
            plain = np.delete(scan, drop)
            starts = np.concatenate([[0], marks + 2 - np.searchsorted(drop, marks + 2)])
            across, down, _, _ = p.shape()
            n = np.full(len(starts), interval or across * down)
            n[-1] = across * down - (len(starts) - 1) * (interval or 0)
            if n[-1] < 1 or n[-1] > n[0]:
                raise ValueError("restart markers do not fit the picture")
            at.append(len(begin))
            begin.extend((starts + base).tolist())
            mcus.extend(n.tolist())
            raw.append(plain)
            base += len(plain)
        values = _lanes(np.concatenate(raw), np.array(begin), np.array(mcus), blocks, len(parts))
        mcus = np.array(mcus)
        for (s, k, p), a, z in zip(mine, at, [*at[1:], len(begin)], strict=True):
            across, down, x, y = p.shape()
            if (mcus[a:z] == mcus[a]).all():
                v = values[a:z, : mcus[a], : x * y].reshape(down, across, y, x)
            else:
                v = np.concatenate([values[i, : mcus[i], : x * y] for i in range(a, z)]).reshape(down, across, y, x)
            v = v.transpose(0, 2, 1, 3).reshape(down * y, across * x)
            v = np.clip((v * p.quantisers[p.components[0].quantiser] + 1028) >> 3, 0, 255).astype(np.uint8)
            high, wide = -(-p.height // 8), -(-p.width // 8)
            if not single:
                most = max(c[0] for c in parts), max(c[1] for c in parts)
                high, wide = -(-p.height * y // (8 * most[1])), -(-p.width * x // (8 * most[0]))
            found[s][k] = (p.width, p.height, v[:high, :wide])
    return found


def difference_hash(picture: np.ndarray) -> str:
    """64 bits in hex: whether each of 8x8 cell means is below the mean of the cell to its right (9x8 cells)."""
    high, wide = picture.shape
    total = np.zeros((high + 1, wide + 1))
    total[1:, 1:] = picture.cumsum(0, dtype=np.float64).cumsum(1)
    y0, x0 = np.arange(8) * high // 8, np.arange(9) * wide // 9
    y1, x1 = np.maximum((np.arange(8) + 1) * high // 8, y0 + 1), np.maximum((np.arange(9) + 1) * wide // 9, x0 + 1)
    area = (y1 - y0)[:, None] * (x1 - x0)
    mean = (total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]) / area
    return f"{int(''.join('1' if b else '0' for b in (mean[:, :-1] < mean[:, 1:]).ravel()), 2):016x}"
