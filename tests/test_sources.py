"""Formats and sinks: round trips, broken files, failed and repeated writes."""

import gzip
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions.crc32c import crc32c
from kinetable.sources import staged, tfrecord


def slow_crc(b):
    c = 0xFFFFFFFF
    for x in b:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c():
    assert slow_crc(b"123456789") == 0xE3069283
    rng = random.Random(3)
    for _ in range(30):
        parts = [rng.randbytes(rng.choice([0, 1, 3, 4, 63, 64, 65, 300, 1000])) for _ in range(rng.randrange(1, 7))]
        got = crc32c(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
        assert got.tolist() == [slow_crc(p) for p in parts]


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


ROWS = [
    (1, "one", bytearray(b"\x00\xff"), 1.5, [0.5, -2.0], [[1, -2], [3]], True),
    (-(2**63), "é", bytearray(b""), -0.0, [], [], False),
    (None, None, None, None, None, None, None),
    (2**63 - 1, "", bytearray(b"x" * 5000), 3.0e38, [float(k) for k in range(300)], [[k] for k in range(200)], None),
]
KIND = "n long, s string, b binary, f double, v array<double>, steps array<array<long>>, flag boolean"


@pytest.mark.parametrize("compression", ["", "gzip"])
def test_records(spark, tmp_path, compression):
    """All kinds of columns, nulls, empty lists, a column more and a column less than written."""
    spark.dataSource.register(tfrecord.TfRecordSource)
    frame = spark.createDataFrame(ROWS, KIND).repartition(2)
    frame.write.format("tfrecord").mode("append").option("compression", compression).save(str(tmp_path))
    assert "_SUCCESS" in files(tmp_path) and not os.path.exists(tmp_path / "_temporary")
    got = spark.read.format("tfrecord").schema(KIND + ", missing string").load(str(tmp_path)).drop("missing").collect()
    plain = lambda r: tuple(x.hex() if isinstance(x, (bytes, bytearray)) else np.float32(x).item() if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, got), key=repr) == sorted(map(plain, ROWS), key=repr)
    assert sorted("-" if r["s"] is None else r["s"] for r in spark.read.format("tfrecord").schema("s string").load(f"{tmp_path}/*.tfrecord*").collect()) == ["", "-", "one", "é"]
    frame.where("false").write.format("tfrecord").mode("overwrite").save(str(tmp_path))
    assert spark.read.format("tfrecord").schema(KIND).load(str(tmp_path)).count() == 0


def test_records_by_hand(spark, tmp_path):
    """A message put together by hand: unpacked integers and unknown fields, after the format's description."""
    spark.dataSource.register(tfrecord.TfRecordSource)
    feature = bytes([0x0A, 1, ord("k"), 0x12, 8, 0x1A, 6, 0x08, 5, 0x08, 0x96, 0x01, 0x00])[:-1]
    entry = bytes([0x0A, len(feature)]) + feature
    body = bytes([0x0A, len(entry)]) + entry + bytes([0x98, 0x06, 7])
    body = body.replace(bytes([0x12, 8, 0x1A, 6]), bytes([0x12, 7, 0x1A, 5]))
    mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    head = struct.pack("<Q", len(body))
    (tmp_path / "a.tfrecord").write_bytes(head + struct.pack("<I", mask(slow_crc(head))) + body + struct.pack("<I", mask(slow_crc(body))))
    assert [r["k"] for r in spark.read.format("tfrecord").schema("k array<long>").load(str(tmp_path)).collect()] == [[5, 150]]


def test_broken_records(spark, tmp_path):
    """A flipped byte of the body, of the length, and a cut file: told with shard and place, or left out."""
    spark.dataSource.register(tfrecord.TfRecordSource)
    spark.range(100).coalesce(1).selectExpr("id", "concat('text ', id) as s").write.format("tfrecord").mode("append").save(f"{tmp_path}/a")
    (name,) = [f for f in os.listdir(tmp_path / "a") if f.startswith("part")]
    whole = (tmp_path / "a" / name).read_bytes()
    size = 16 + struct.unpack("<Q", whole[:8])[0]
    read = lambda mode="failFast": spark.read.format("tfrecord").schema("id long, s string").option("mode", mode).load(f"{tmp_path}/b")
    for at, left, said in ((size + 14, 99, "checksum"), (size + 2, 1, "length"), (len(whole) - 1, 99, "cut off")):
        os.makedirs(tmp_path / "b", exist_ok=True)
        bad = whole[:at] if said == "cut off" else whole[:at] + bytes([whole[at] ^ 4]) + whole[at + 1 :]
        (tmp_path / "b" / "x.tfrecord").write_bytes(bad)
        with pytest.raises(Exception, match=rf"x\.tfrecord.*{said}") as e:
            read().collect()
        assert said == "cut off" or f"byte {size}" in str(e.value)
        assert read("dropMalformed").count() == left
    (tmp_path / "b" / "x.tfrecord").write_bytes(b"")
    (tmp_path / "b" / "y.tfrecord.gz").write_bytes(gzip.compress(whole))
    assert read().count() == 100


def test_failed_write_leaves_nothing(spark, tmp_path):
    """A task that fails after others have written: no file is seen, what was there stays."""
    spark.dataSource.register(tfrecord.TfRecordSource)
    spark.range(3).write.format("tfrecord").mode("append").save(f"{tmp_path}/t")
    before = files(tmp_path / "t")
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("late"))).cast("long").alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="late"):
            bad.write.format("tfrecord").mode(mode).save(f"{tmp_path}/t")
        assert files(tmp_path / "t") == before and not os.path.exists(tmp_path / "t" / "_temporary")
    assert sorted(r["id"] for r in spark.read.format("tfrecord").schema("id long").load(f"{tmp_path}/t").collect()) == [0, 1, 2]


def test_found_files(tmp_path):
    for name in ("a/x.h5", "a/_hidden/y.h5", "b/x.h5", "b/z.txt", "_temporary/j/x.h5"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    named = lambda uri: [p.removeprefix(f"{tmp_path}/") for p, _ in staged.files_of(uri)]
    assert named(str(tmp_path)) == ["a/x.h5", "b/x.h5", "b/z.txt"]
    assert named(f"file://{tmp_path}/*/x.h5") == ["a/x.h5", "b/x.h5"] and named(f"{tmp_path}/b/z.txt") == ["b/z.txt"]
    with pytest.raises(FileNotFoundError):
        staged.files_of(f"{tmp_path}/none")


STEPS_OF = "episode_id string, step int, `action/v` array<double>, `obs/state/g` double, `obs/n` long, `obs/name` string, `obs/none` double"


def written(path, n, chunk, filters, seed=0):
    from kinetable.sources.hdf5 import file_bytes

    rng = np.random.default_rng(seed)
    a = {"action/v": rng.normal(size=(n, 3)), "obs/state/g": rng.normal(size=n), "obs/n": rng.integers(-(2**40), 2**40, n), "obs/name": np.array([f"é{k}" for k in range(n)]), "obs/unread": rng.normal(size=(n, 40))}
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/trajectory.h5", "wb") as f:
        f.write(file_bytes(a, chunk, filters))
    return [(k, a["action/v"][k].tolist(), float(a["obs/state/g"][k]), int(a["obs/n"][k]), f"é{k}", None) for k in range(n)]


@pytest.mark.parametrize("n,chunk,filters,part", [(7, 100, (), 1 << 26), (500, 16, (2, 1), 1 << 26), (500, 16, (1,), 5_000), (4_500, 7, (2, 1), 40_000), (1, 1, (2,), 100)])
def test_array_files(spark, tmp_path, n, chunk, filters, part):
    """One and many chunks, trees of several levels, filters, files dealt by ranges of steps: every step once."""
    from kinetable.sources.hdf5 import Hdf5Source

    spark.dataSource.register(Hdf5Source)
    want = {f"e{k}": written(tmp_path / f"e{k}", n + k, chunk, filters, k) for k in range(2)}
    got = spark.read.format("hdf5").schema(STEPS_OF).option("partBytes", part).load(f"{tmp_path}/*/*.h5")
    rows = {}
    for r in got.collect():
        rows.setdefault(r[0], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in rows.items()} == want
    if part < 50_000 and n > 400:
        assert got.rdd.getNumPartitions() > 3
    assert spark.read.format("hdf5").schema("step int, `obs/n` long").load(f"{tmp_path}/e0").where("step = 0").first()["obs/n"] == want["e0"][0][3]


class Counting:
    """An open file that notes how much is read of it."""

    def __init__(self, data):
        self.data, self.most, self.total = data, 0, 0

    def read_at(self, size, offset):
        self.most, self.total = max(self.most, size), self.total + size
        return self.data[offset : offset + size]


def test_array_files_are_not_held_whole():
    """A few rows of one data set cost its chunks and some headers."""
    from kinetable.sources.hdf5 import File, file_bytes

    rng = np.random.default_rng(1)
    source = Counting(file_bytes({"a": rng.normal(size=(20_000, 8)), "b": rng.normal(size=(20_000, 8))}, 64))
    file = File(source)
    a = file.array(file.find("a"))
    assert file.values(a, 10_000, 10_003) == np.random.default_rng(1).normal(size=(20_000, 8))[10_000:10_003].tolist()
    assert source.total < len(source.data) / 20 and source.most < 10_000


def second_format(data):
    """A file of the newer form by hand: superblock 2, object headers 2 with a continuation, compact links, single and implicit chunks, contiguous and compact data, heap texts."""
    import zlib as z

    out = bytearray(48)

    def put(b):
        out.extend(b"\0" * (-len(out) % 8) + b)
        return len(out) - len(b)

    def header(messages, split=None):
        pack = lambda ms: b"".join(struct.pack("<BHB", k, len(b), 0) + b for k, b in ms)
        if split is not None:
            rest = b"OCHK" + pack(messages[split:]) + b"sums"
            messages = [*messages[:split], (16, struct.pack("<QQ", put(rest), len(rest)))]
        body = pack(messages)
        return put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"sums")

    double = bytes([0x11, 0x20, 63, 0]) + struct.pack("<I", 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023)
    big = bytes([0x10, 9, 0, 0]) + struct.pack("<I", 2) + struct.pack("<HH", 0, 16)
    space = lambda *n: struct.pack("<BBBB", 2, len(n), 0, 1) + struct.pack(f"<{len(n)}Q", *n)
    raw = data.astype("<f8").tobytes()
    packed = z.compress(raw) + b"sums"
    single = struct.pack("<BBBBBBBB", 4, 2, 2, 3, 1, len(data), 2, 8) + bytes([1]) + struct.pack("<QIQ", len(packed), 0, put(packed))
    half = np.zeros((4, 2))
    half[:3] = data[:3]
    grid = b"".join(half[k : k + 2, j : j + 1].astype("<f8").tobytes() for k in (0, 2) for j in (0, 1))
    implicit = struct.pack("<BBBBBBBB", 4, 2, 0, 3, 1, 2, 1, 8) + bytes([2]) + struct.pack("<Q", put(grid))
    pipeline = bytes([2, 2]) + struct.pack("<HHHI", 1, 0, 1, 6) + struct.pack("<HHH", 3, 0, 0)
    heap = put(b"GCOL" + struct.pack("<B3xQ", 1, 72) + struct.pack("<HH4xQ", 1, 1, 3) + b"pick\0\0\0\0"[:8] + struct.pack("<HH4xQ", 2, 1, 5) + b"place\0\0\0" + struct.pack("<HH4xQ", 0, 0, 8))
    texts = put(b"".join(struct.pack("<IQI", n, heap, i) for n, i in ((3, 1), (5, 2), (0, 0))))
    vlen = bytes([0x19, 1, 0, 0]) + struct.pack("<I", 16) + bytes([0x13, 0, 0, 0]) + struct.pack("<I", 1)
    items = {
        "one": header([(1, space(*data.shape)), (3, double), (11, pipeline), (8, single)], 2),
        "grid": header([(1, space(3, 2)), (3, double), (8, implicit)]),
        "run": header([(1, space(3)), (3, big), (8, bytes([3, 1]) + struct.pack("<QQ", put(struct.pack(">3h", 1, -2, 300)), 6))]),
        "near": header([(1, space(3)), (3, double), (8, bytes([3, 0]) + struct.pack("<H", 24) + struct.pack("<3d", 1, 2, 3))]),
        "unset": header([(1, space(3)), (3, double), (8, bytes([3, 1]) + struct.pack("<QQ", 2**64 - 1, 0))]),
        "text": header([(1, space(3)), (3, vlen), (8, bytes([3, 1]) + struct.pack("<QQ", texts, 48))]),
        "told": header([(1, struct.pack("<BBBB", 2, 0, 0, 0)), (3, big), (8, bytes([3, 0]) + struct.pack("<H", 2) + struct.pack(">h", 9))]),
    }
    root = header([(6, struct.pack("<BBB", 1, 0, len(k)) + k.encode() + struct.pack("<Q", at)) for k, at in items.items()], 3)
    out[:48] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBB4Q4x", 2, 8, 8, 0, 0, 2**64 - 1, len(out), root)
    return bytes(out)


def test_array_files_of_the_newer_form(spark, tmp_path):
    from kinetable.sources.hdf5 import Hdf5Source

    spark.dataSource.register(Hdf5Source)
    data = np.arange(6.0).reshape(3, 2) / 4
    os.makedirs(tmp_path / "ep7")
    (tmp_path / "ep7" / "x.h5").write_bytes(second_format(data))
    schema = "episode_id string, step int, one array<double>, grid array<double>, run int, near double, unset double, text string, told array<int>"
    got = sorted(map(tuple, spark.read.format("hdf5").schema(schema).load(str(tmp_path)).collect()))
    assert got == [("ep7", k, data[k].tolist(), data[k].tolist(), (1, -2, 300)[k], k + 1.0, 0.0, ("pic", "place", "")[k], [9]) for k in range(3)]


def test_broken_array_files(spark, tmp_path):
    """Cut, foreign and damaged files are told by name."""
    from kinetable.sources.hdf5 import Hdf5Source

    spark.dataSource.register(Hdf5Source)
    written(tmp_path / "e", 300, 16, (2, 1))
    whole = (tmp_path / "e" / "trajectory.h5").read_bytes()
    for bad in (whole[:40], b"no" + whole[2:], whole[:200] + b"\xff" * 4_000 + whole[4_200:]):
        (tmp_path / "e" / "trajectory.h5").write_bytes(bad)
        with pytest.raises(Exception, match=r"e/trajectory\.h5"):
            spark.read.format("hdf5").schema(STEPS_OF).load(str(tmp_path)).collect()


def test_intervals(spark):
    """Brute force over short, long, empty and touching intervals and null bounds; the plan has no nested loop."""
    from kinetable.operators.ranges import in_intervals

    rng = random.Random(7)
    points = [(i, rng.choice([1, 2, None]), rng.choice([None, rng.randrange(-2_000, 2_000), rng.randrange(-(2**40), 2**40)])) for i in range(400)]
    spans = []
    for i in range(150):
        b = rng.randrange(-2_000, 2_000)
        spans.append((i, rng.choice([1, 2, None]), b, rng.choice([b, b + 1, b + 7, b + 1024, b + rng.randrange(5_000), b + 2**40, b - 1, None])))
    got = in_intervals(spark.createDataFrame(points, "p int, k int, at long"), spark.createDataFrame(spans, "i int, k int, b long, e long"), ["k"], "at", "b", "e")
    want = sorted((p, i) for p, k, x in points for i, own, b, e in spans if None not in (k, x, e) and k == own and b <= x <= e)
    assert sorted((r["p"], r["i"]) for r in got.collect()) == want and len(want) > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan
    empty = spark.createDataFrame([], "i int, k int, b long, e long")
    assert in_intervals(spark.createDataFrame(points, "p int, k int, at long"), empty, ["k"], "at", "b", "e").count() == 0


def test_collapsed(spark):
    """Members that are arrays of one value become it; lists of several, texts with brackets, keys with quotes stay."""
    from kinetable.functions import nested

    cases = {
        '{"a": [5]}': '{"a":5}', '{"a": [[[ 5 ]]]}': '{"a":5}', '{"a": [[1], [2]]}': '{"a":[[1],[2]]}', '{"a": ["x"]}': '{"a":"x"}', '{"a": "[5]"}': '{"a":"[5]"}',
        '{"a": "b\\":[5],", "c": [true]}': '{"a":"b\\":[5],","c":true}', '{"a": {"b": [null], "c": []}}': '{"a":{"b":null,"c":[]}}', '[7]': "7", '[[7]]': "7", "[1, 2]": "[1,2]", "5": "5",
        '{"a": [{"b": [1.5]}]}': '{"a":[{"b":1.5}]}', '{"a": ["[1]"]}': '{"a":"[1]"}', "broken": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "j string")
    got = {r["j"]: r["c"] for r in rows.select("j", nested.collapsed(F.col("j")).alias("c")).collect()}
    assert got == {**cases, None: None}
    v = spark.createDataFrame([('{"it\'s": {"x": [[3]]}}',)], "j string").select(nested.as_variant(F.col("j")).alias("v"))
    one = v.select(nested.walk(F.col("v"), "it's", "x", kind="int").alias("x"), nested.walk(F.col("v"), "it's", "y", 3).alias("y"), nested.without_batch(nested.with_batch(F.lit(4))).alias("b")).first()
    assert tuple(one) == (3, None, 4)
    assert nested.schema_of(v, F.col("v")).first()["schema"] == "OBJECT<`it's`: OBJECT<x: BIGINT>>"


def test_items_show_whole_or_not_at_all(spark, tmp_path):
    """A failing picture leaves no folder; reading the manifest again writes nothing; an episode written again is replaced; pictures without items are told."""
    from kinetable.sources import sinks

    schema = "dataset string, episode_id long, step int, rank int, tag string, question string, choices array<string>, correct_answer int, image_ids array<string>"
    rows = spark.createDataFrame([("d", e, k, 1, "t", f"q{k}", list("abcde"), 0, [f"i{e}"]) for e in range(6) for k in range(3)], schema)
    told = spark.createDataFrame([("d", e, "go") for e in range(6)], "dataset string, episode_id long, language_instruction string")
    png = F.when(F.col("episode_id") < 5, F.lit(b"x")).otherwise(F.raise_error(F.lit("no picture")).cast("binary"))
    images = spark.range(8).select(F.lit("d").alias("dataset"), F.col("id").alias("episode_id"), F.concat(F.lit("i"), "id").alias("image_id"))
    with pytest.raises(Exception, match="no picture"):
        sinks.write_items(rows, images.withColumn("png", png), told, str(tmp_path / "base"))
    assert not (tmp_path / "base").exists() or files(tmp_path / "base") == []
    done = sinks.write_items(rows, images.withColumn("png", F.lit(b"x")), told, str(tmp_path / "base"))
    assert sorted((r["episode_id"], r["items"], r["images"]) for r in done.collect()) == [(str(e), 3 if e < 6 else 0, 1) for e in range(8)]
    before = {f: os.stat(tmp_path / "base" / f).st_mtime_ns for f in files(tmp_path / "base")}
    assert done.count() == 8 and {f: os.stat(tmp_path / "base" / f).st_mtime_ns for f in files(tmp_path / "base")} == before
    sinks.write_items(rows.where("episode_id = 1 and step = 0"), images.where("false").withColumn("png", F.lit(b"x")), told, str(tmp_path / "base"))
    assert "d/1/images/i1.png" not in files(tmp_path / "base") and "d/1/vqa_data.json" in files(tmp_path / "base") and "d/2/images/i2.png" in files(tmp_path / "base")
    assert sinks.write_items(rows.where("false"), images.where("false").withColumn("png", F.lit(b"x")), told, str(tmp_path / "none")).count() == 0


def test_figures_of_the_quarantine(spark):
    from pyspark.sql import Observation

    from kinetable.operators import items

    rows = spark.createDataFrame([(k, 0, 1, "t", "q", c) for k, c in enumerate([list("abcde"), list("abc"), ["Yes", "No", "x", "y"], [], None, ["No", " Yes ", "x", "y"]])], "episode_id int, step int, rank int, tag string, question string, choices array<string>")
    figures = Observation()
    items.finalize(rows, figures=figures).write.format("noop").mode("overwrite").save()
    assert figures.get == {"seen": 6, "taken": 3, "rejected": 3, "without_choices": 2} and items.rejected(rows).count() == 3


def test_steps_of_array_files(spark, tmp_path):
    from kinetable.sources.episodes import read_hdf5
    from kinetable.sources.hdf5 import file_bytes

    for e, extra in (("a", {}), ("b", {"action/joint_velocity": np.ones((3, 2))})):
        os.makedirs(tmp_path / e)
        arrays = {"action/cartesian_position": np.arange(18.0).reshape(3, 6), "action/gripper_position": np.array([0, 0.5, 1]), "observation/robot_state/cartesian_position": np.zeros((3, 6)), "observation/robot_state/gripper_position": np.array([0.1, 0.2, 0.3])}
        (tmp_path / e / "trajectory.h5").write_bytes(file_bytes(arrays | extra))
    rows = {(r["episode_id"], r["step"]): r for r in read_hdf5(spark, f"{tmp_path}/*/trajectory.h5").collect()}
    assert sorted(rows) == [(e, k) for e in "ab" for k in range(3)]
    assert rows["a", 1]["gripper_position"] == 0.2 and rows["a", 2]["action"] == {"cartesian_position": [12.0, 13.0, 14.0, 15.0, 16.0, 17.0], "gripper_position": [1.0]}
    assert rows["b", 0]["action"]["joint_velocity"] == [1.0, 1.0] and rows["b", 0]["cartesian_position"] == [0.0] * 6


def test_events_are_shards_for_all_cores(spark, small):
    """A table of one partition is written and read back by more tasks than one."""
    from kinetable.source_queries import QUERIES

    assert spark.read.parquet(f"{small}/events.parquet").rdd.getNumPartitions() == 1
    got = QUERIES["tfrecord_events"](spark, small)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert got.count() == spark.read.parquet(f"{small}/events.parquet").count()


def test_checksum_of_one_message_is_that_of_many():
    import random

    from kinetable.functions.crc32c import masked_one
    from kinetable.sources.tfrecord import checksums

    messages = [random.Random(k).randbytes(k % 40) for k in range(300)]
    assert [masked_one(m) for m in messages] == checksums(messages).tolist()
