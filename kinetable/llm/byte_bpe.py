"""Byte-level BPE by a segment tree of pair ranks.

A text is split by the tokenizer's pattern; within each match, a segment tree over byte positions
holds the rank of the pair that begins at each live position.  Its root is the least rank, its
leftmost occurrence is found by descending; a merge updates the positions of the merged part, its
left neighbour and the part it swallowed, each in logarithmic time, so even a match of a megabyte
takes n log n steps.  Matches recur, so their ids are kept in a bounded table per Python worker.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import byte_slices, in_small_batches, trimmed

NO_PAIR = 1 << 60
KEPT_PIECES = 500_000
KEPT_LENGTH = 64
MAX_RANK_FILE = 32 << 20
SLICE = 1 << 20


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: the least-ranked pair is merged, leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    tree = [NO_PAIR] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NO_PAIR)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a <= b else b
            if tree[i] == best:
                return
            tree[i] = best

    while tree[1] != NO_PAIR:
        best, node = tree[1], 1
        while node < size:
            node *= 2
            if tree[node] != best:
                node += 1
        at = node - size
        gone = after[at]
        end = after[gone]
        after[at] = end
        put(gone, NO_PAIR)
        if end < n:
            before[end] = at
            put(at, get(piece[at : after[end]], NO_PAIR))
        else:
            put(at, NO_PAIR)
        left = before[at]
        if left >= 0:
            put(left, get(piece[left:end], NO_PAIR))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Pieces(dict):
    """Packed ids by match; emptied when full, and long matches are not kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", merge_piece(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def _latin(pattern: str) -> str | None:
    """The pattern for texts of U+0000-U+00FF with its properties spelled out, which the quicker ``re`` takes."""
    classes = {
        r"\p{L}": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff",
        r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe",
        r"\s": r"\t-\r \x85\xa0",
    }
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((k for k in (*classes, r"\S") if pattern.startswith(k, i)), pattern[i : i + 2] if pattern[i] == "\\" else pattern[i])
        if name == r"\S" and not inside:
            out.append(f"[^{classes[chr(92) + 's']}]")
        elif name in classes:
            out.append(classes[name] if inside else f"[{classes[name]}]")
        elif name[0] == "\\":
            return None
        else:
            inside = name == "[" or inside and name != "]"
            out.append(name)
        i += len(name)
    return "".join(out)


class Tokenizer:
    """Encodes texts to packed little-endian unsigned 32-bit ids and decodes them."""

    def __init__(self, rank_file: bytes, pattern: str):
        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pieces = _Pieces(self.ranks)
        self.find = regex.compile(pattern).findall
        quick = _latin(pattern)
        self.find_latin = re.compile(quick).findall if quick else self.find
        self.sizes = np.zeros(max(self.ranks.values(), default=-1) + 1, np.int64)
        for token, rank in self.ranks.items():
            self.sizes[rank] = len(token)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            find = self.find_latin
        except UnicodeEncodeError:
            find = self.find
        return b"".join(map(self.pieces.__getitem__, find(text)))

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of each row of packed ids."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        size = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        whole = self.bytes[np.arange(ends[-1]) + np.repeat(self.begins[ids] - ends[:-1], size)].tobytes()
        cuts = ends[np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int64)].tolist()
        return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(rank_file: bytes, pattern: str) -> Tokenizer:
    """One tokenizer for each rank file and pattern in a Python process."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(rank_file, pattern)
    return _tokenizers[key]


def read_ranks(path: str) -> bytes:
    """The rank file, whose size is checked because it is broadcast."""
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_FILE + 1)
    if len(raw) > MAX_RANK_FILE:
        raise ValueError("the rank file is larger than 32 MB")
    return raw


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit) and decoded (bytes) of each whole text.

    A null text counts as empty and has no ids.  Texts of any length are taken whole, each match of the pattern by
    itself.  Repeated rows and null ids keep their rows; an empty table gives none; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches):
        t = tokenizer(shared.value, pattern)
        for whole in batches:
            for b in byte_slices(whole, "text", SLICE):
                ids = [t.encode(x) if x else b"" for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(t.decode(ids), pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    own = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(trimmed(run), "doc_id long, ids binary, decoded binary")


def decode(rows: DataFrame, rank_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text of packed ids; a null is no ids, bytes that are not UTF-8 become U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches):
        t = tokenizer(shared.value, "")
        for b in batches:
            texts = [x.decode("utf-8", "replace") for x in t.decode([x or b"" for x in b.column("ids").to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(trimmed(run), "doc_id long, text string")
