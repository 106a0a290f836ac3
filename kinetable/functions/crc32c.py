"""CRC-32C of many byte strings at once, in numpy.

The checksum is linear, and zeros before a message change nothing when it starts from zero.  So messages are padded in front
and cut to pieces, all pieces walk in lockstep, and neighbours are joined pairwise: the left one is moved past the
right one's bytes by a table of that length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The reflected polynomial, and what masks a stored checksum.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
PIECE = 64
_U = np.uint32


@lru_cache(None)
def _step() -> np.ndarray:
    t = np.arange(256, dtype=_U)
    for _ in range(8):
        t = (t >> _U(1)) ^ np.where(t & _U(1), _U(POLYNOMIAL), _U(0))
    return t


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & _U(255)] ^ table[1][c >> _U(8) & _U(255)] ^ table[2][c >> _U(16) & _U(255)] ^ table[3][c >> _U(24)]


@lru_cache(None)
def _past(power: int) -> np.ndarray:
    """Tables that move a checksum past ``2 ** power`` zero bytes."""
    if power:
        half = _past(power - 1)
        return np.stack([_apply(half, t) for t in half])
    c = np.arange(256, dtype=_U)[None] << (_U(8) * np.arange(4, dtype=_U))[:, None]
    return _step()[c & _U(255)] ^ (c >> _U(8))


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The checksum of each ``data[offsets[i]:offsets[i + 1]]``, bytes."""
    size = np.diff(offsets)
    pieces = np.maximum(-(-size // PIECE), 1)
    first = np.concatenate([[0], np.cumsum(pieces)])
    padded = np.zeros(int(first[-1]) * PIECE, np.uint8)
    shift = first[1:] * PIECE - offsets[1:]  # each message ends where its last piece does
    padded[np.arange(offsets[0], offsets[-1]) + np.repeat(shift, size)] = data[offsets[0] : offsets[-1]]
    crc, step = np.zeros(int(first[-1]), _U), _step()
    for column in np.ascontiguousarray(padded.reshape(-1, PIECE).T):
        crc = step[(crc ^ column) & _U(255)] ^ (crc >> _U(8))
    power = PIECE.bit_length() - 1
    while pieces.max(initial=1) > 1:
        room = pieces + pieces % 2 * (pieces > 1)
        begin = np.concatenate([[0], np.cumsum(room)])
        even = np.zeros(int(begin[-1]), _U)
        even[np.arange(len(crc)) + np.repeat(begin[1:] - np.cumsum(pieces), pieces)] = crc
        single = np.repeat(room == 1, room)
        pair = np.flatnonzero(~single)[::2]
        out = np.flatnonzero(single)
        merged = np.concatenate([even[out], _apply(_past(power), even[pair]) ^ even[pair + 1]])
        crc = merged[np.argsort(np.concatenate([out, pair]), kind="stable")]
        pieces, power = np.maximum(room // 2, 1), power + 1
    start = np.full(len(size), 0xFFFFFFFF, _U)  # the first state, moved past all bytes of a message
    for power in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero(size >> power & 1)
        start[at] = _apply(_past(power), start[at])
    return crc ^ start ^ _U(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Checksums as record files store them."""
    return ((crc >> _U(15)) | (crc << _U(17))) + _U(MASK)


@lru_cache(None)
def _steps() -> list[int]:
    return _step().tolist()


def masked_one(data: bytes) -> int:
    """The checksum of one short message as record files store it, without numpy's cost of a call."""
    crc, step = 0xFFFFFFFF, _steps()
    for x in data:
        crc = step[(crc ^ x) & 255] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return (crc >> 15 | crc << 17 & 0xFFFFFFFF) + MASK & 0xFFFFFFFF
