"""Benchmark decontamination in DataFrame functions only.

A window has as many words as a benchmark item; a text shorter than the item is one window.  Every
window gets a SimHash of four longs from its five-word shingles, weighted by how often they occur.  A
multi-index of 16 blocks finds every pair of a window and an item of its size within RADIUS bits: of
16 blocks that differ in 63 bits at most, one differs in at most floor(63 / 16) = 3.  Items are entered
under every value within two bits of a block, windows look up every value within one.  Pairs within the
radius are decided by exact weighted similarity: shared shingles over all, by multiplicity.

Which windows.  One that shares no shingle with any item of its size has similarity 0, so only windows
that hold at least one are made: each by its leftmost such shingle, so none twice.

Recall.  A bit of a window and an item that share 80 % (their vectors' cosine is 8/9 at equal sizes)
differs with probability 0.15; of 252 bits more than 63 do with probability 4e-6.

The benchmark's shingles are broadcast only up to BROADCAST_WORDS words and its index entries only up to
BROADCAST_PROBES; beyond, the same joins shuffle, and the items alone are entered within three bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ensure_checkpoint_dir

WIDTH = 5
PERCENT = 80
LONGS = 4
#: Where each block of a long begins and its bits.
PARTS = ((0, 16), (16, 16), (32, 16), (48, 15))
BLOCKS = LONGS * len(PARTS)
BLOCK_RADIUS = 3
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BROADCAST_WORDS = 1_000_000
BROADCAST_PROBES = 2_000_000
NULL_ID = -(2**63)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: str, width: int) -> Column:
    """A hash for each run of ``width`` words, in order; none if there are fewer words."""
    run = ", ".join(f"{words}[i + {k}]" for k in range(width))
    return F.expr(f"if(size({words}) < {width}, array(), transform(sequence(0, greatest(size({words}) - {width}, 0)), i -> xxhash64({run})))")


def lane_of(most: int) -> int:
    """Bits of a counter that holds up to ``most`` and has its top bit free."""
    return next(w for w in (9, 21, 31) if most < 1 << (w - 1))


def simhash(hashes: str, lane: int) -> Column:
    """A bit is set if more than half of the shingles, by multiplicity, have it set; the sign bit never is.

    A long holds several counters of ``lane`` bits each, ``lane`` longs all of them.  Adding what a
    counter lacks to its top bit, for all counters at once, sets that bit where more than half are set.
    """
    lanes = 63 // lane
    ones = sum(1 << (lane * j) for j in range(lanes))
    lack = f"({1 << (lane - 1)}L - (size({hashes}) div 2 + 1)) * {ones}L"
    parts = [
        f"shiftleft(shiftrightunsigned(aggregate({hashes}, 0L, (a, x) -> a + (shiftrightunsigned(x, {k}) & {ones}L)) + {lack}, {lane - 1}) & {ones}L, {k})"
        for k in range(lane)
    ]
    return F.expr(f"coalesce({' | '.join(parts)}, 0L)")


def with_prints(rows: DataFrame, hashes: str, lane: int) -> DataFrame:
    """``rows`` with the fingerprint's longs f0, f1, ... of an array of shingle hashes."""
    more = rows.withColumns({f"_h{k}": F.expr(f"transform({hashes}, x -> xxhash64(x, {k}))") for k in range(1, LONGS)})
    made = more.withColumns({f"f{k}": simhash(f"_h{k}" if k else hashes, lane) for k in range(LONGS)})
    return made.drop(*[f"_h{k}" for k in range(1, LONGS)])


def masks(bits: int) -> Column:
    """All values of 16 bits with at most ``bits`` set."""
    values = [sum(1 << k for k in places) for n in range(bits + 1) for places in combinations(range(16), n)]
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def block_values(first: str = "f", second: str | None = None) -> list[str]:
    """Each block's value, or where ``second`` is given, its difference between two fingerprints."""
    longs = [f"{first}{k}" if second is None else f"({first}{k} ^ {second}{k})" for k in range(LONGS)]
    return [f"(shiftrightunsigned({x}, {at}) & {(1 << bits) - 1}L)" for x in longs for at, bits in PARTS]


def keyed(rows: DataFrame, bits: int, *kept: str) -> DataFrame:
    """``kept`` columns, block, mask and key for every value within ``bits`` of each block."""
    values = F.expr("array(" + ", ".join(f"named_struct('b', {b}L, 'v', {v})" for b, v in enumerate(block_values())) + ")")
    each = rows.select(*kept, F.explode(values).alias("_at")).select(*kept, F.col("_at.b").alias("b"), F.col("_at.v").alias("v"))
    each = each.withColumn("m", F.explode(masks(bits)))
    return each.select(*kept, "b", "m", F.expr("shiftleft(cast(n as long), 20) | shiftleft(b, 16) | (v ^ m)").alias("key"))


def shared_weight(a: str, b: str) -> Column:
    """Shingles in common, each as often as in the one that has it less often."""
    plain = f"size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b})"
    often = f"aggregate(array_distinct({b}), 0, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    return F.expr(f"if({plain}, size(array_intersect({a}, {b})), {often})")


def item_table(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """item_id, n (words), width (of a shingle), w of the items that have an id and words."""
    return (
        benchmark.select(F.col(item_col).cast("long").alias("item_id"), words_of(F.col(item_text_col).cast("string")).alias("w"))
        .where("item_id is not null and size(w) > 0").dropDuplicates(["item_id", "w"])
        .withColumns({"n": F.size("w"), "width": F.least(F.size("w"), F.lit(WIDTH))})
    )


def windows(own: DataFrame, items: DataFrame, widths: list[int], broadcast: bool) -> DataFrame:
    """doc, th, n, h: the shingle hashes of every window of ``own(doc, th, text)`` that holds a shingle of an item of its size.

    A shingle that an item has takes with it the hashes around, as far as a window with it can reach; so
    texts are read once, and only these rows are shuffled, to find the one before in the same text.
    """
    places = items.select("n", "width", F.explode("h").alias("s")).distinct()
    worded = own.select("doc", "th", F.monotonically_increasing_id().alias("rid"), words_of(F.col("text")).alias("w"))
    if len(widths) == 1:
        hashed = worded.select("doc", "th", "rid", F.size("w").alias("words"), F.lit(widths[0]).alias("width"), shingle_hashes("w", widths[0]).alias("hs"))
    else:
        each = F.array(*[F.struct(F.lit(k).alias("width"), shingle_hashes("w", k).alias("hs")) for k in widths])
        hashed = worded.select("doc", "th", "rid", F.size("w").alias("words"), F.explode(each).alias("e")).select("doc", "th", "rid", "words", "e.width", "e.hs")
    # by position: of an array that is exploded itself a planner asks first if it is empty, which is to hash each text twice
    place = F.expr("explode(if(size(hs) = 0, array(), sequence(0, size(hs) - 1)))").alias("p")
    runs = hashed.select("doc", "th", "rid", "words", "width", "hs", place).withColumn("s", F.expr("hs[p]"))
    met = runs.join(F.broadcast(places) if broadcast else places, ["s", "width"])
    around = met.withColumn("from", F.expr("greatest(p - (n - width), 0)")).select(
        "doc", "th", "rid", "words", "width", "n", "p", "from", F.expr("slice(hs, from + 1, p - from + n - width + 1)").alias("near")
    )
    # dealt here, as the rows are few but make many windows each: a planner that goes by bytes would merge the parts
    key = ["doc", "th", "rid", "n"]
    around = around.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    before = F.lag("p").over(Window.partitionBy(*key).orderBy("p"))
    begins = around.withColumn("first", F.greatest(F.coalesce(before + 1, F.lit(0)), "from")).withColumn("last", F.expr("least(p, greatest(words - n, 0))")).where("first <= last")
    return begins.select("doc", "th", "n", F.expr("explode(transform(sequence(first, last), a -> slice(near, a - from + 1, n - width + 1)))").alias("h"))


def found_items(own: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame | None:
    """doc, th, item_id: which texts of ``own(doc, th, text)`` hold which items; None if there are no items."""
    items = item_table(benchmark, item_col, item_text_col)
    facts = items.agg(F.count("*").alias("items"), F.sum("n").alias("words"), F.max(F.expr("n - width + 1")).alias("most"), F.collect_set("width").alias("widths")).first()
    if not facts["items"]:
        return None
    widths, lane = sorted(facts["widths"]), lane_of(facts["most"])
    hashes = shingle_hashes("w", widths[-1])
    for k in widths[:-1]:
        hashes = F.when(F.col("width") == k, shingle_hashes("w", k)).otherwise(hashes)
    items = items.select("item_id", "n", "width", hashes.alias("h"))
    items = with_prints(items.select("*", F.xxhash64("item_id", "n", "h").alias("item")), "h", lane).checkpoint()
    few = facts["words"] <= BROADCAST_WORDS
    entries = BLOCKS * 137 * facts["items"]
    hint = F.broadcast if few and entries <= BROADCAST_PROBES else lambda x: x
    reach = 1 if few and entries <= BROADCAST_PROBES else 0
    probes = keyed(items, BLOCK_RADIUS - reach, "item", "n").select("item", "key")
    made = with_prints(windows(own, items, widths, few), "h", lane)
    prints = [f"f{k}" for k in range(LONGS)]
    looked = keyed(made, reach, "doc", "th", "n", "h", *prints)
    other = items.select("item", "item_id", F.col("n").alias("item_n"), F.col("h").alias("item_h"), *[F.col(f).alias(f"g{k}") for k, f in enumerate(prints)])
    pairs = looked.join(hint(probes), "key").join(hint(other), "item").where("n = item_n")
    apart = " + ".join(f"bit_count(f{k} ^ g{k})" for k in range(LONGS))
    differ = block_values("f", "g")
    # a pair is kept where its first block within the radius meets, by the lowest bit of a difference of three; so it is verified once
    first = "case " + " ".join(f"when bit_count({d}) <= {BLOCK_RADIUS} then named_struct('b', {b}L, 'd', {d})" for b, d in enumerate(differ)) + " end"
    near = pairs.where(f"{apart} <= {RADIUS}").withColumn("at", F.expr(first)).where(f"at.b = b and m = if(bit_count(at.d) <= {BLOCK_RADIUS - reach}, 0L, at.d & -at.d)")
    judged = near.select("doc", "th", "item_id", "h", "item_h", shared_weight("h", "item_h").alias("same"))
    return judged.where(f"100 * same >= {PERCENT} * (size(h) + size(item_h) - same)").select("doc", "th", "item_id").distinct()


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, item_ids (sorted) for each distinct document id.

    Items of fewer than five words are one shingle, their whole sequence.  Null and wordless texts and
    items, and items without an id, match nothing; an empty table of either has no hits.  Rows that repeat
    an id count as one document, each text looked at by itself; so do those with a null id.  Items that
    repeat an id are found under it if any of their texts is.  Texts of any length are taken whole.  Other columns are not looked at.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    own = _own(docs, id_col, text_col)
    found = found_items(own, benchmark, item_col, item_text_col)
    ids = own.select("doc").distinct()
    name = F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id")
    none = F.array().cast("array<long>")
    if found is None:
        return ids.select(name, F.lit(False).alias("contaminated"), none.alias("item_ids"))
    hits = found.groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return ids.join(hits, "doc", "left").select(name, F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose own text holds no item; a row goes by its text alone, whatever its id.

    Nulls, empty texts and tables as in ``contaminated``; repeated rows stay or go together.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    found = found_items(_own(docs, id_col, text_col), benchmark)
    if found is None:
        return docs
    bad = found.select(F.col("doc").alias("_doc"), F.col("th").alias("_th")).distinct().checkpoint()
    if bad.count() <= BROADCAST_WORDS:
        bad = F.broadcast(bad)
    key = (F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)) == bad["_doc"]) & (F.xxhash64(F.col(text_col).cast("string")) == bad["_th"])
    return docs.join(bad, key, "left_anti")


#: The same decisions by plain SQL: every window of every text that has a shingle in common with an item of the window's size, shingles as text.
SQL = r"""
WITH d AS (SELECT coalesce(doc_id, -9223372036854775808) AS doc, row_number() OVER () AS rid, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT row_number() OVER () AS item, item_id, w, len(w) AS n, least(len(w), 5) AS k FROM b WHERE len(w) > 0),
ish AS (SELECT item, item_id, n, k, array_to_string(list_slice(w, q + 1, q + k), ' ') AS s FROM (SELECT *, unnest(range(n - k + 1)) AS q FROM i)),
ks AS (SELECT DISTINCT k FROM i),
dsh AS (SELECT doc, rid, k, p, len(w) AS words, array_to_string(list_slice(w, p + 1, p + k), ' ') AS s FROM (SELECT doc, rid, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k)),
met AS (SELECT DISTINCT rid, words, k, n FROM dsh JOIN (SELECT DISTINCT n, k, s FROM ish) USING (k, s)),
win AS (SELECT rid, k, n, unnest(range(greatest(words - n, 0) + 1)) AS a FROM met),
wsh AS (SELECT doc, rid, win.k, win.n, a, s, count(*) AS c FROM win JOIN dsh USING (rid, k) WHERE p BETWEEN a AND a + win.n - win.k GROUP BY ALL),
wn AS (SELECT rid, k, n, a, sum(c) AS m FROM wsh GROUP BY ALL),
ic AS (SELECT item, item_id, n, k, s, count(*) AS c FROM ish GROUP BY ALL),
both_ AS (SELECT doc, rid, wsh.k, wsh.n, a, item, item_id, sum(least(wsh.c, ic.c)) AS x FROM wsh JOIN ic USING (n, k, s) GROUP BY ALL),
hit AS (SELECT DISTINCT doc, item_id FROM both_ JOIN wn USING (rid, k, n, a) WHERE 100 * x >= 80 * (m + n - k + 1 - x)),
g AS (SELECT doc, list_sort(list(item_id)) AS item_ids FROM hit GROUP BY doc)
SELECT nullif(doc, -9223372036854775808) AS doc_id, item_ids IS NOT NULL AS contaminated, coalesce(len(item_ids), 0)::BIGINT AS n_items, coalesce(array_to_string(item_ids, ','), '') AS item_ids
FROM (SELECT DISTINCT doc FROM d) LEFT JOIN g USING (doc)
"""
