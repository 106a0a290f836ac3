"""MinHash near-duplicate detection by chosen-path similarity join.

Every distinct shingle set gets a signature of minwise tokens.  A tree of the chosen-path join sends
each set to a node by one minwise token; nodes of more than LEAF sets branch on two tokens chosen by the
node, smaller ones are compared exhaustively by signature, and so are nodes that stay large to the last of LEVELS
levels: all with the first member, then those unlike it with all.  Where that would be more than LAST_PAIRS comparisons a
node branches on, to DEEPEST levels at most: texts that merely share a passage part there, while
groups of near copies don't but have few that are unlike the first.  Independent trees repeat this until the target recall is met.
Nodes of more than NODE_ROWS sets branch across the cluster, the others inside a task, by the same rule, so
the trees are the same wherever they grow; there the unlike ones are compared in cells of SPREAD by SPREAD signatures.  What they yield are candidate links; all pairs of texts inside
a component of these are then decided by exact comparison of the full sets, in blocks of bounded size.

Exact comparison.  A component of one block is compared as it is.  A larger one is compared block by
block, then one text for each group found, as long as that joins groups; so a group of n near copies moves n full
sets, and some more for its heads.  At the end the texts outside its largest group are compared with all others by wide
signatures of 256 bytes, which cells of SPREAD by SPREAD hold: n rows up to SPREAD sets, beyond that n for each SPREAD.
Full sets are fetched for the pairs alone that agree in WIDE_AGREE places and aren't tied yet, first the best one of each
two groups in a cell, as long as that joins groups, then all that are left: texts at similarity
0.5 do so with probability 1e-8, at 0.6 with 1e-2, so a family of many texts that all but reach the threshold is the one
case where the pairs that are verified outgrow the texts.

Recall.  A pair at similarity 0.8 is together in a tree's root node with probability 0.8 and stays so at
each of five branchings with 1 - 0.2^2 at least, so a tree whose nodes all stay large misses it with probability
0.35 and ten trees with 3e-5; deeper ones don't miss it more, as it lives on in 1.6 nodes of the next level on average, and in
none ever after with 0.06 at most; the signature test (37 of 64 tokens) misses it with probability 3e-6, the wide one with 1e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import binary_rows, byte_slices, dealt_by, in_small_batches, trimmed
from .graph import connected_components, ensure_checkpoint_dir
from .textcore import distinct, mix, shingles, utf8, words

COORDS = 64
TREES = 10
LEAF = 24
LEVELS = 6
AGREE = 37
BLOCK = 256
NODE_ROWS = 200_000
LAST_PAIRS = 100_000_000
DEEPEST = 30
SPREAD = 16_384
WIDE = 256
WIDE_AGREE = 173
BROADCAST_ROWS = 500_000

_rng = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOTS = [int(x) for x in _rng.permutation(COORDS)]
_WIDE_MULTIPLY = _rng.integers(1, 2**63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 16 upper bits of the least value under each of COORDS hash functions; zero rows for empty sets."""
    n = len(starts) - 1
    sig = np.zeros((n, COORDS), np.uint16)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        for k in range(COORDS):
            sig[some, k] = np.minimum.reduceat(((sets * _MULTIPLY[k]) >> np.uint64(24)).astype(np.uint32), starts[some]) * np.uint32(0x9E3779B1) >> 16
    return sig


def _sets(batch: pa.RecordBatch, width: int):
    buf, off = utf8(batch.column("text"))
    _, _, row, h = words(buf, off)
    return distinct(*shingles(row, h, batch.num_rows, width))


def _sketch(width: int):
    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, "text"):
                sets, starts = _sets(b, width)
                n = np.diff(starts)
                d = np.zeros((2, b.num_rows), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    d[0, some] = np.add.reduceat(sets, starts[some])
                    d[1, some] = np.add.reduceat(mix(sets), starts[some])
                d = d.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("th"), pa.array(n), pa.array(d[0]), pa.array(d[1]), binary_rows(signatures(sets, starts))],
                    ["doc_id", "th", "n", "d1", "d2", "sig"],
                )

    return run


def _runs(batches, key: str):
    """Tables that hold each run of equal keys of a sorted partition whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        others = np.flatnonzero(k != k[-1])
        last = int(others[-1]) + 1 if len(others) else 0
        if last or (held and held[0].column(key)[0].as_py() != k[0]):
            held.append(b.slice(0, last))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _children(key: np.ndarray, sig: np.ndarray, level: int) -> list[np.ndarray]:
    """The two nodes of the next level that each set of a node goes to: by two tokens that the node chooses."""
    out = []
    for j in range(2):
        seed = mix(key + np.uint64(level * 2 + j + 1))
        c = (seed >> np.uint64(32)) % np.uint64(COORDS)
        out.append(mix(seed + sig[np.arange(len(sig)), c.astype(np.int64)].astype(np.uint64)))
    return out


def _branch(start: np.ndarray, begin: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links, as pairs of row numbers, of nodes ``start`` of levels ``begin`` and all below them."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    key, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for level in range(DEEPEST):
        here = np.flatnonzero(begin == level)
        key, at = np.concatenate([start[here], key]), np.concatenate([here, at])
        if not len(key):
            if level >= LEVELS and not (begin > level).any():
                break
            continue
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        run = np.repeat(np.arange(len(first)), size)
        small = (size > 1) & (size <= LEAF)
        live = np.flatnonzero(small[run])
        for shift in range(1, LEAF):
            live = live[live + shift < len(key)]
            live = live[run[live] == run[np.minimum(live + shift, len(key) - 1)]]
            if not len(live):
                break
            for part in np.array_split(live, len(live) // 50_000 + 1):
                x, y = at[part], at[part + shift]
                near = (sig[x] == sig[y]).sum(1) >= AGREE
                left.append(x[near])
                right.append(y[near])
        on = size > LEAF
        if level >= LEVELS - 1:
            for a in np.flatnonzero(on).tolist():
                members = at[first[a] : first[a] + size[a]]
                if level < DEEPEST - 1 and size[a] ** 2 > LAST_PAIRS and size[a] * (~_like(sig[members], sig[members[0]])).sum() > LAST_PAIRS:
                    continue
                on[a] = False
                x, y = _last(members, sig)
                left.append(x)
                right.append(y)
        large = on[run]
        key, at = key[large], at[large]
        key, at = np.concatenate(_children(key, sig[at], level)), np.concatenate([at, at])
    x, y = np.concatenate(left), np.concatenate(right)
    return x[x != y], y[x != y]


def _like(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sig == one).sum(1) >= AGREE


def _last(members: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what like signatures join among a node's members: all with the first, then those unlike it with all."""
    own = sig[members]
    like = _like(own, own[0])
    like[0] = True
    root = np.where(like, 0, np.arange(len(members)))
    ahead, others = _ties(np.flatnonzero(~like), own, own, root)
    rest = np.flatnonzero(like)[1:]
    return members[np.concatenate([np.zeros(len(rest), np.int64), ahead])], members[np.concatenate([rest, others])]


def _ties(probes: np.ndarray, of: np.ndarray, own: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probe, place in ``own``): a tie to each group, by ``root``, of which rows ``probes`` of ``of`` are like a member; groups are joined on the way."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in probes.tolist():
        near = np.flatnonzero(_like(own, of[i]))
        groups, one = np.unique(root[near], return_index=True)
        left.append(np.full(len(one), i))
        right.append(near[one])
        if len(groups):
            root[np.isin(root, groups)] = groups[0]
    return np.concatenate(left), np.concatenate(right)


def _signatures_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDS)


def _compare(batches):
    for t in _runs(batches, "node"):
        ids = t["rep"].to_numpy()
        x, y = _branch(t["node"].to_numpy().view(np.uint64), t["level"].to_numpy(), _signatures_of(t["sig"]))
        pairs = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _deeper(batches):
    """Both children of each row's node, one level down."""
    for b in batches:
        if b.num_rows:
            level = b.column("level")[0].as_py()  # rows of one level
            for key in _children(b.column("node").to_numpy().view(np.uint64), _signatures_of(b.column("sig")), level):
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("sig"), pa.array(key.view(np.int64)), pa.array(np.full(b.num_rows, level + 1, np.int32))], ["rep", "sig", "node", "level"])


def _full_sets(width: int):
    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, "text"):
                sets, starts = _sets(b, width)
                view = pa.py_buffer(np.ascontiguousarray(sets))
                tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(starts * 8), view]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("coarse"), b.column("size"), tokens, binary_rows(signatures(sets, starts))], ["rep", "coarse", "size", "tokens", "sig"])

    return run


def _exact(num: int, den: int):
    """(a, b) for each ``own`` of a group that exact links tie to a smaller one: itself and the smallest it is tied to.

    Sets of one ``own`` are tied already.
    """

    def tied(own, tokens, sig):
        n = np.array([len(x) for x in tokens])
        i, j = np.triu_indices(len(own), 1)
        ok = (own[i] != own[j]) & (np.minimum(n[i], n[j]) * den >= num * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        agree = np.concatenate([(sig[i[k : k + 20_000]] == sig[j[k : k + 20_000]]).sum(1) for k in range(0, len(i), 20_000)] or [np.zeros(0, int)])
        order = np.argsort(-agree, kind="stable")
        order = order[agree[order] >= AGREE]
        names, place = np.unique(own, return_inverse=True)
        root = list(range(len(names)))

        def find(a):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for k in order:
            a, b = int(i[k]), int(j[k])
            ra, rb = find(int(place[a])), find(int(place[b]))
            if ra == rb:
                continue
            small, big = (tokens[a], tokens[b]) if n[a] < n[b] else (tokens[b], tokens[a])
            found = np.searchsorted(big, small)
            both = int((big[np.minimum(found, len(big) - 1)] == small).sum())
            if both * den >= num * (n[a] + n[b] - both):
                root[max(ra, rb)] = min(ra, rb)
        return [(int(names[k]), int(names[r])) for k in range(len(names)) if (r := find(k)) != k]

    def run(batches):
        for t in _runs(batches, "group"):
            group, own = t["group"].to_numpy(), t["own"].to_numpy()
            tokens = [np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist()]
            sig = _signatures_of(t["sig"])
            cut = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
            pairs = [p for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1 for p in tied(own[a:b], tokens[a:b], sig[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return run


def candidate_links(reps: DataFrame, trees: int = TREES) -> DataFrame:
    """(a, b) candidate links between sets ``reps(rep, sig)`` by ``trees`` chosen-path trees."""
    roots = [F.struct(F.lit(t).alias("tree"), F.expr(f"substring(sig, {2 * _ROOTS[t] + 1}, 2)").alias("token")) for t in range(trees)]
    rows = reps.select("rep", "sig", F.explode(F.array(*roots)).alias("root")).select("rep", "sig", F.xxhash64("root.tree", "root.token").alias("node"), F.lit(0).alias("level"))
    schema = "rep long, sig binary, node long, level int"
    done, ties = None, None
    for level in range(DEEPEST):  # nodes too large for a task branch across the cluster
        over = rows.groupBy("node").count().where(F.col("count") > NODE_ROWS).select("node").checkpoint()
        if over.isEmpty():
            break
        rest, large = rows.join(over, "node", "left_anti").select("rep", "sig", "node", "level"), rows.join(over, "node", "left_semi").select("rep", "sig", "node", "level")
        done = rest if done is None else done.unionByName(rest)
        if level >= LEVELS - 1:
            large, found = _settled(large, level == DEEPEST - 1)
            ties = found if ties is None else ties.unionByName(found)
        rows = large.mapInArrow(trimmed(_deeper), schema).checkpoint() if level < DEEPEST - 1 else None
        if rows is None:
            break
    grown = done if rows is None else rows if done is None else done.unionByName(rows)
    pairs = dealt_by(grown, "node").sortWithinPartitions("node", "rep").mapInArrow(trimmed(_compare), "a long, b long")
    return (pairs if ties is None else pairs.unionByName(ties)).distinct()


def _settled(large: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes that branch on, and (a, b) of those that don't: as ``_last``, with cells of signatures in place of a task.

    A member goes to a cell for each SPREAD members unlike its node's first, those to one for each SPREAD members.
    """
    head = large.groupBy("node").agg(F.min("rep").alias("head"), F.min_by("sig", "rep").alias("head_sig"))

    def judge(batches):
        for b in batches:
            like = (_signatures_of(b.column("sig")) == _signatures_of(b.column("head_sig"))).sum(1) >= AGREE if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "sig", "node", "level", "head")), pa.array(like)], ["rep", "sig", "node", "level", "head", "alike"])

    judged = large.join(head, "node").mapInArrow(trimmed(judge), "rep long, sig binary, node long, level int, head long, alike boolean").checkpoint()
    sizes = judged.groupBy("node").agg(F.count("*").alias("m"), F.count_if(~F.col("alike")).alias("u"))
    settled = sizes.where(F.lit(last) | (F.col("m") * F.col("u") <= 100 * LAST_PAIRS))
    here = judged.join(settled, "node").withColumns({"us": F.ceil(F.col("u") / SPREAD).cast("int"), "ms": F.ceil(F.col("m") / SPREAD).cast("int")})
    to_head = here.where("alike and rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    base = here.where("us > 0").select("rep", "sig", F.lit(False).alias("probe"), F.expr("explode(transform(sequence(0, us - 1), i -> xxhash64(node, i, cast(pmod(xxhash64(rep), ms) as int))))").alias("node"))
    probe = here.where("not alike").select("rep", "sig", F.lit(True).alias("probe"), F.expr("explode(transform(sequence(0, ms - 1), i -> xxhash64(node, cast(pmod(xxhash64(rep), us) as int), i)))").alias("node"))
    cells = base.unionByName(probe).repartition("node").sortWithinPartitions("node")
    return judged.join(settled, "node", "left_anti").select("rep", "sig", "node", "level"), to_head.unionByName(cells.mapInArrow(trimmed(_cells), "a long, b long"))


def _cells(batches):
    """(a, b): ties that join what like signatures of a cell's probes and other members join."""
    for t in _runs(batches, "node"):
        node, rep, probe, sig = t["node"].to_numpy(), t["rep"].to_numpy(), t["probe"].to_numpy(zero_copy_only=False), _signatures_of(t["sig"])
        cut = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            base, ask = np.flatnonzero(~probe[a:b]) + a, np.flatnonzero(probe[a:b]) + a
            x, y = _ties(np.arange(len(ask)), sig[ask], sig[base], np.arange(len(base)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[ask[x]]), pa.array(rep[base[y]])], ["a", "b"])


def _linked(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b) of what exact links tie inside each group of ``dealt(own, tokens, sig, group)``."""
    return dealt.repartition("group").sortWithinPartitions("group", "own").mapInArrow(trimmed(_exact(percent, 100)), "a long, b long")


def _blocks(size: str) -> str:
    return f"cast(ceil({size} / {BLOCK}) as int)"


def _relabelled(labels: DataFrame, ties: DataFrame) -> DataFrame:
    """``labels(rep, coarse, label)`` with each label replaced by what it is tied to."""
    return labels.join(ties, F.col("label") == F.col("a"), "left").select("rep", "coarse", F.coalesce("b", "label").alias("label")).checkpoint()


def exact_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that give the exact components of ``sets(rep, coarse, size, tokens, sig)`` within each ``coarse`` of ``size`` sets."""
    links = _linked(sets.where(f"size <= {BLOCK}").select(F.col("rep").alias("own"), "tokens", "sig", F.col("coarse").alias("group")), percent)
    large = sets.where(f"size > {BLOCK}").checkpoint()
    if large.isEmpty():
        return links
    block = F.expr(f"xxhash64(coarse, pmod(xxhash64(rep), {_blocks('size')}))").alias("group")
    ties = _linked(large.select(F.col("rep").alias("own"), "tokens", "sig", block), percent).checkpoint()
    labels = large.select("rep", "coarse", F.col("rep").alias("label"))
    while not ties.isEmpty():
        links, labels = links.unionByName(ties), _relabelled(labels, ties)
        heads = labels.where("rep = label")  # one set for each group
        several = heads.groupBy("coarse").agg(F.count("*").alias("heads")).where("heads > 1")
        own = large.drop("coarse").join(heads.join(several, "coarse"), "rep")
        block = F.expr(f"xxhash64(coarse, pmod(xxhash64(rep), {_blocks('heads')}))").alias("group")
        ties = _linked(own.select(F.col("rep").alias("own"), "tokens", "sig", block), percent).checkpoint()
    # what is outside a component's largest group, by all others: the best pair of each two groups until that ties none, then all pairs
    own = large.select("rep", "tokens")
    wide = own.mapInArrow(trimmed(_widened), "rep long, n int, wide binary").checkpoint()
    while True:
        ties = _verified(_agreeing(wide, labels, percent, best=True), own, percent).checkpoint()
        if ties.isEmpty():
            return links.unionByName(_verified(_agreeing(wide, labels, percent, best=False), own, percent))
        of = labels.select("rep", "label")
        named = ties.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        moved = connected_components(named).where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        links, labels = links.unionByName(ties), _relabelled(labels, moved)


def _agreeing(wide: DataFrame, labels: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b) of sets in different groups of a component whose wide signatures agree; of each two groups in a cell the best pair alone, if so asked."""
    return dealt_to_cells(wide, labels).repartition("cell").sortWithinPartitions("cell").mapInArrow(trimmed(_wide_pairs(percent, best)), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose full ``sets(rep, tokens)`` are linked."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(trimmed(_linked_pairs(percent)), "a long, b long")


def dealt_to_cells(wide: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, rep, label, n, wide): each set outside its component's largest group meets all others of it in one cell.

    ``wide(rep, n, wide)`` are signatures, ``labels(rep, coarse, label)`` the groups so far.  Up to SPREAD sets make a cell or two.
    """
    groups = labels.groupBy("coarse", "label").agg(F.count("*").alias("n"))
    most = groups.groupBy("coarse").agg(F.max(F.struct("n", "label")).alias("x"), F.sum("n").alias("total")).select("coarse", F.col("x.label").alias("main"), F.col("x.n").alias("n"), (F.col("total") - F.col("x.n")).alias("others"))
    cells = F.expr(
        "if(label = main, transform(sequence(0, r - 1), i -> xxhash64(coarse, 'main', i, cast(pmod(xxhash64(rep), m) as int))),"
        " concat(transform(sequence(0, r - 1), i -> xxhash64(coarse, 'rest', least(i, mine), greatest(i, mine))), transform(sequence(0, m - 1), i -> xxhash64(coarse, 'main', mine, i))))"
    )
    blocks = lambda size: F.ceil(F.col(size) / SPREAD).cast("int")
    places = labels.join(most.where("others > 0"), "coarse").withColumns({"r": blocks("others"), "m": blocks("n")}).withColumn("mine", F.expr("cast(pmod(xxhash64(rep), r) as int)"))
    return places.select("rep", "label", F.explode(cells).alias("cell")).join(wide, "rep").select("cell", "rep", "label", "n", "wide")


def _widened(batches):
    for b in batches:
        sets = [np.frombuffer(x, np.uint64) for x in b.column("tokens").to_pylist()]
        wide = np.zeros((len(sets), WIDE), np.uint8)
        for k, x in enumerate(sets):
            for part in np.array_split(np.arange(WIDE), max(len(x) * WIDE >> 20, 1)):
                wide[k, part] = ((((x * _WIDE_MULTIPLY[part, None]) >> np.uint64(24)).astype(np.uint32)).min(1) * np.uint32(0x9E3779B1)) >> 24
        yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([len(x) for x in sets], pa.int32()), binary_rows(wide)], ["rep", "n", "wide"])


def _wide_pairs(percent: int, best: bool):
    """(a, b) of a cell's sets of different groups, of like size, that agree in WIDE_AGREE places."""

    def chosen(found, rep, label):
        """Rows of ``found``, (one, other, places they agree in) arrays: all, or the first of each two groups by places."""
        x, y, same = (np.concatenate(z) for z in zip(*found, strict=True))
        if best:
            pair = np.sort(np.stack([label[x], label[y]], 1), axis=1)
            order = np.lexsort((y, x, -same, pair[:, 1], pair[:, 0]))
            x, y, same, pair = x[order], y[order], same[order], pair[order]
            first = np.append(True, (pair[1:] != pair[:-1]).any(1))
            x, y, same = x[first], y[first], same[first]
        return [(x, y, same)]

    def run(batches):
        for t in _runs(batches, "cell"):
            cell, rep, label, n = (t[c].to_numpy() for c in ("cell", "rep", "label", "n"))
            wide = np.frombuffer(b"".join(t["wide"].to_pylist()), np.uint8).reshape(-1, WIDE)
            cut = np.append(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                order = a + np.argsort(n[a:b], kind="stable")
                size, own, group = n[order], wide[order], label[order]
                stop = np.searchsorted(size, size * 100 // percent, "right")  # sets that are not too large for it
                found, held = [], 0
                for i in range(b - a - 1):
                    others = np.flatnonzero(group[i + 1 : stop[i]] != group[i]) + i + 1
                    same = (own[others] == own[i]).sum(1)
                    near = same >= WIDE_AGREE
                    if near.any():
                        others, same = order[others[near]], same[near]
                        found.append((np.full(len(others), order[i]), others, same))
                        held += len(others)
                    if held > 200_000:
                        found = chosen(found, rep, label)
                        held = len(found[0][0])
                        if not best or held > 200_000:
                            yield table(rep, found)
                            found, held = [], 0
                if found:
                    yield table(rep, chosen(found, rep, label))

    def table(rep, found):
        return pa.RecordBatch.from_arrays([pa.array(rep[found[0][0]]), pa.array(rep[found[0][1]])], ["a", "b"])

    return run


def _linked_pairs(percent: int):
    """(a, b) of the rows whose full sets ``x`` and ``y`` are linked."""

    def run(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column("x"), t.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, big = (x, y) if len(x) < len(y) else (y, x)
                both = int((big[np.minimum(np.searchsorted(big, small), len(big) - 1)] == small).sum())
                ok.append(both * 100 >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, trees: int) -> DataFrame:
    """doc_id, th (the text's hash), n, component (null: of its own), component_id for each row of ``docs``."""
    ensure_checkpoint_dir(docs.sparkSession)
    text = F.col(text_col).cast("string")
    own = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sketch = own.mapInArrow(trimmed(_sketch(width)), "doc_id long, th long, n long, d1 long, d2 long, sig binary").checkpoint()
    reps = sketch.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.min("th").alias("th"), F.count("*").alias("copies"))
    reps = reps.withColumn("rep", F.monotonically_increasing_id()).checkpoint()  # numbers of the sets, written down
    able = reps.where(f"n * {100 - percent} >= {percent}").select("rep", "sig")
    coarse = connected_components(candidate_links(able, trees)).checkpoint()
    sizes = coarse.groupBy("component").agg(F.count("*").alias("size"))
    members = coarse.join(sizes, "component").select(F.col("node").alias("rep"), F.col("component").alias("coarse"), "size").join(reps.select("rep", "th"), "rep")
    if coarse.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    texts = own.join(members, "th").groupBy("rep", "coarse", "size").agg(F.min("text").alias("text"))
    sets = texts.mapInArrow(trimmed(_full_sets(width)), "rep long, coarse long, size long, tokens binary, sig binary")
    final = connected_components(exact_links(sets, percent))
    named = reps.join(final, reps.rep == final.node, "left").where("copies > 1 or node is not null").select("n", "d1", "d2", "least", F.coalesce("component", "rep").alias("component")).checkpoint()
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    keys = named.join(least, "component").select("n", "d1", "d2", "component", "component_id")
    return sketch.drop("sig").join(keys, ["n", "d1", "d2"], "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 80, trees: int = TREES) -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles, component_id, kept, one row for each row of ``docs``.

    Two rows are linked if ``100 * shared >= percent * union`` of their distinct ``width``-word
    shingles.  Null and wordless texts have an empty set and are linked with nothing; an empty table gives
    no rows.  Rows that repeat an id each get the component of their own text.  A null id gets the smallest
    id of its component, null if there is none, and counts as kept only then.  Texts of any length are
    taken whole.  Columns besides id and text are not looked at.
    """
    found = _classes(docs, id_col, text_col, width, percent, trees)
    name = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, trees: int = TREES) -> DataFrame:
    """One row, with all its columns, of each near-duplicate group of ``docs``, and all rows that have none.

    It is the row with the smallest id, nulls last; of rows with this id one with the smallest text hash; of
    rows that repeat both any one.  Rows without words are no group and stay.  What goes is found by id and
    text hash, so texts are shuffled only if more than BROADCAST_ROWS such pairs go.
    """
    mark = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "th")
    grouped = _classes(docs, id_col, text_col, width, percent, trees).where("component is not null").select("component", "doc_id", "th")
    rows = grouped.groupBy("component", "doc_id", "th").agg(F.count("*").alias("times")).checkpoint()
    chosen = rows.groupBy("component").agg(F.min(mark).alias("x")).select("component", F.col("x.doc_id").alias("_id"), F.col("x.th").alias("_th"))
    judged = rows.join(chosen, "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    judged = judged.where("not stays or times > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "stays").checkpoint()
    gone, repeated = judged.select("_id", "_th"), judged.where("stays").select("_id", "_th")
    if judged.count() <= BROADCAST_ROWS:
        gone, repeated = F.broadcast(gone), F.broadcast(repeated)
    own_id, own_th = docs[id_col].cast("long"), F.xxhash64(docs[text_col].cast("string"))
    kept = docs.join(gone, own_id.eqNullSafe(gone["_id"]) & (own_th == gone["_th"]), "left_anti")
    if not repeated.isEmpty():
        once = docs.join(repeated, own_id.eqNullSafe(repeated["_id"]) & (own_th == repeated["_th"]), "left_semi")
        once = once.withColumns({"__key_id": F.col(id_col).cast("long"), "__key_th": F.xxhash64(F.col(text_col).cast("string"))})
        kept = kept.unionByName(once.dropDuplicates(["__key_id", "__key_th"]).select(*docs.columns))
    return kept


#: near_duplicates with two-word shingles by plain SQL: every pair of sets of like size that share a shingle, and all that links reach.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
t AS (SELECT s.doc_id, s.s, n.n FROM s JOIN n USING (doc_id)),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS least_ FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, c.least_) AS component_id, d.doc_id = least(d.doc_id, c.least_) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
