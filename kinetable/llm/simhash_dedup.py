"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has a bit for each of 64 that is set in over half of the hashes of its four-word shingles, repeats
included.  Two fingerprints that differ in at most RADIUS = 4 bits, cut into SEGMENTS = 3 segments, differ by at most one bit
in one of them, as 2 + 2 + 2 would be more than 4.  So each fingerprint is entered once for every segment and every bit of it
with that bit left out: 64 keys.  Two segments that differ by one bit at most have a variant in common, so fingerprints that are
linked meet at a key; what meets is verified on all 64 bits.

Equal fingerprints are one row before anything is compared.  A key's members are compared in a task that keeps a spanning
set of links, never all pairs.  Where more than BUCKET fingerprints meet at a key, those near the least of them are tied to it,
and the members are dealt anew by variants of the bits that the key doesn't fix, within the key: linked fingerprints differ in
four of these bits at most, too, so the same argument holds.  A key whose members are in one component already is
left out before that.  At the last level no bits are left to deal by; few fingerprints fit there, and they are compared in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtools import dealt_by, in_small_batches, trimmed
from .graph import connected_components, ensure_checkpoint_dir
from .near_dedup import _runs

RADIUS = 4
SEGMENTS = 3
WIDTH = 4
SEED = 42
#: Fingerprints at one key that one task compares with each other.
BUCKET = 2_048
#: Rows (fingerprint and component, or crowded key) up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Segments of fewer bits are not cut again.
LEAST_BITS = 4
PIECE = 1 << 15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    """64 bits of a text's word shingles; 0 without words."""
    words = text.translate(_LOWER).split()  # at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    made = max(len(words) - WIDTH + 1, 1)
    begins, ends = begins[:made].tolist(), ends[min(WIDTH, len(words)) - 1 :].tolist()
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, made, PIECE):
        some = np.array([h(joined[a:b], SEED) for a, b in zip(begins[k : k + PIECE], ends[k : k + PIECE], strict=True)], "<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > made, bitorder="little").view("<u8")[0])


def _sketch(batches):
    for b in batches:
        text = b.column("text").cast(pa.large_binary())
        prints = np.array([fingerprint(t.as_py() or b"") for t in text], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def wildcard_masks() -> list[tuple[int, int, int, int]]:
    """(free, segment, mask, rest): for bits that are free, each segment of them, the segment without one bit, and the bits free below.

    From all 64 bits down to where a segment would have fewer than LEAST_BITS; 1,769 rows.
    """
    out, level = [], {(1 << 64) - 1}
    while level:
        below = set()
        for free in level:
            bits = [k for k in range(64) if free >> k & 1]
            for segment in np.array_split(bits, SEGMENTS):
                whole = sum(1 << int(k) for k in segment)
                out += [(free, whole, whole & ~(1 << int(k)), free & ~whole) for k in segment]
                if (free & ~whole).bit_count() >= SEGMENTS * LEAST_BITS:
                    below.add(free & ~whole)
        level = below
    return [tuple(map(_signed, x)) for x in out]


def _opened(rows: DataFrame, whole: bool) -> DataFrame:
    """``rows(fp, key, free)``, each once for every mask of its free bits; if all bits are free (``whole``) the masks are constants."""
    masks = wildcard_masks()
    if whole:
        first = [F.struct(*[F.lit(x).alias(n) for x, n in zip(m[1:], ("segment", "mask", "rest"), strict=True)]) for m in masks if m[0] == -1]
        return rows.select("fp", "key", "free", F.explode(F.array(*first)).alias("m")).select("fp", "key", "free", "m.*")
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(masks, "free long, segment long, mask long, rest long")), "free")


def _variants(rows: DataFrame, whole: bool) -> DataFrame:
    """(fp, key, free): each of ``rows(fp, key, free)`` once for every one-wildcard variant of a segment of its free bits."""
    key = F.xxhash64("key", "mask", F.col("fp").bitwiseAND(F.col("mask")))
    return _opened(rows, whole).select("fp", key.alias("key"), F.col("rest").alias("free"))


def _crowded(rows: DataFrame, whole: bool, bucket: int) -> DataFrame:
    """(key) of the variants of ``rows`` that more than ``bucket`` fingerprints may share; all others have fewer.

    A variant's members have one of two values of its segment, so one of these has over half of them; values are
    counted, three a row, not variants.
    """
    one = F.col("segment").bitwiseXOR(F.col("mask"))
    lowest = one == F.col("segment").bitwiseAND(-F.col("segment"))  # a segment's values by one of its masks
    value = F.col("fp").bitwiseAND(F.col("segment")).alias("value")
    counts = _opened(rows, whole).where(lowest).groupBy("key", "free", "segment", value).count()
    hot = counts.where(F.col("count") > bucket // 2).select("key", "free", "segment", "value")
    masks = F.broadcast(rows.sparkSession.createDataFrame(wildcard_masks(), "free long, segment long, mask long, rest long"))
    return hot.join(masks, ["free", "segment"]).select(F.xxhash64("key", "mask", F.col("value").bitwiseAND(F.col("mask"))).alias("key")).distinct()


def spanning(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what links of distinct ``prints`` join: each is compared with all, one is kept for each tie."""
    n = len(prints)
    root = np.arange(n)
    left, right = [], []
    for i in range(1, n):
        near = np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= RADIUS)
        groups, one = np.unique(root[near], return_index=True)
        if len(groups):
            left.append(np.full(len(one), i))
            right.append(near[one])
            if len(groups) > 1:
                root[np.isin(root[:i], groups).nonzero()[0]] = groups[0]
            root[i] = groups[0]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _meet(batches):
    """(a, b) of verified links between the fingerprints of each key; runs of a key come whole."""
    for t in _runs(batches, "key"):
        key, fp = t["key"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        left, right = [], []
        small = np.repeat(size <= 16, size)
        run = np.repeat(np.arange(len(first)), size)
        live = np.flatnonzero(small)
        for shift in range(1, 16):
            live = live[: np.searchsorted(live, len(key) - shift)]
            live = live[run[live] == run[live + shift]]
            if not len(live):
                break
            near = live[np.bitwise_count(fp[live] ^ fp[live + shift]) <= RADIUS]
            left.append(fp[near])
            right.append(fp[near + shift])
        for k in np.flatnonzero(size > 16).tolist():
            some = fp[first[k] : first[k] + size[k]]
            x, y = spanning(some)
            left.append(some[x])
            right.append(some[y])
        none = np.zeros(0, np.uint64)
        a, b = np.concatenate([none, *left]).view(np.int64), np.concatenate([none, *right]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def _compared(rows: DataFrame) -> DataFrame:
    return dealt_by(rows.select("fp", "key"), "key").sortWithinPartitions("key").mapInArrow(trimmed(_meet), "a long, b long").distinct()


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that tie all of ``prints(fp)``, distinct, that chains of links of at most RADIUS bits tie."""
    rows, out = prints.select("fp", F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free")), None
    whole = True
    while True:
        over, made = _crowded(rows, whole, bucket).checkpoint(), _variants(rows, whole)
        if over.isEmpty():
            found = _compared(made)
            return found if out is None else out.unionByName(found)
        if over.count() <= BROADCAST_ROWS:
            over = F.broadcast(over)
        found = _compared(made.join(over, "key", "left_anti"))
        members = made.join(over, "key", "left_semi").checkpoint()
        head = members.groupBy("key").agg(F.min("fp").alias("head"))
        tied = members.join(head, "key").where((F.col("fp") != F.col("head")) & _near(F.col("fp"), F.col("head"))).select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct()
        out = (found if out is None else out.unionByName(found)).unionByName(tied).checkpoint()
        label = connected_components(out)
        named = members.join(label, members.fp == label.node, "left").select("key", F.coalesce("component", "fp").alias("label"))
        several = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        open_ = members.join(several, "key", "left_semi").checkpoint()
        last = F.bit_count("free") < SEGMENTS * LEAST_BITS
        whole = False
        out, rows = out.unionByName(_in_blocks(open_.where(last), bucket)), open_.where(~last)
        if rows.isEmpty():
            return out


def _in_blocks(rows: DataFrame, bucket: int) -> DataFrame:
    """Verified links inside each key of ``rows(fp, key)``, all blocks against all, where no bits are left to deal by.

    A key at the last level fixes all but some tens of bits, so its size is bounded whatever the table's is.
    """
    sizes = rows.groupBy("key").count()
    cells = F.expr("transform(sequence(0, r - 1), i -> xxhash64(key, least(i, mine), greatest(i, mine)))")
    dealt = rows.join(sizes, "key").withColumn("r", F.ceil(F.col("count") / (bucket // 2)).cast("int")).withColumn("mine", F.expr("cast(pmod(xxhash64(fp), r) as int)"))
    return _compared(dealt.select("fp", F.explode(cells).alias("key")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs``: near-duplicates by 64-bit SimHash.

    A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``; shingles are four words joined by a space, fewer words the
    whole sequence; hashes are XXH64 with seed 42.  Rows whose fingerprints differ in four bits at most are linked, and
    ``component_id`` is the smallest id that links reach, the row's own included.

    Null and wordless texts have fingerprint zero and are linked like any other.  Texts of any length are taken whole.
    Repeated ids and rows each get the component of their own text.  A null id gets the smallest id of its
    component, null if there is none.  An empty table gives no rows.  Columns besides id and text are not looked at.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    own = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = own.mapInArrow(trimmed(_sketch), "doc_id long, fp long").checkpoint()
    prints = sketch.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).checkpoint()
    label = connected_components(links(prints.select("fp"), bucket))
    named = prints.join(label, prints.fp == label.node, "left").where("copies > 1 or node is not null").select("fp", "least", F.coalesce("component", "fp").alias("component")).checkpoint()
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = named.join(least, "component").select("fp", "component_id", F.lit(True).alias("grouped"))
    if named.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    name = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return sketch.join(groups, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), name.alias("component_id"))
