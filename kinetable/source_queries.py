"""Registered queries of the sources and sinks: tables written in a format, read back and compared with the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import nested, phrases, pictures
from .functions.folders import ensure_checkpoint_dir
from .functions.text import EXTRACTION_DEMO
from .operators import evaluation, items, ranges, raster
from .plans import evaluate
from .sources import cache_table, episodes, sinks
from .sources.hdf5 import Hdf5Source
from .sources.tfrecord import TfRecordSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


#: Rows of a record shard.
SHARD_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value::FLOAT::DOUBLE AS value, props FROM events")
def tfrecord_events(spark, d):
    """Events written as record shards, an example a row, and read back; numbers are floats of 32 bits there."""
    spark.dataSource.register(TfRecordSource)
    at, events = shared_folder(spark, "tfrecord"), table(spark, d, "events")
    shards = max(spark.sparkContext.defaultParallelism, -(-events.count() // SHARD_ROWS))  # few large files are few partitions, and a shard is one when read
    events.repartition(shards).write.format("tfrecord").mode("append").save(at)
    return spark.read.format("tfrecord").schema(events.schema).load(at).withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


SEVEN = ", ".join(f"embedding[{k}]::DOUBLE AS a{k}" for k in range(1, 8))


def seven(array: str) -> list[Column]:
    return [F.get(array, F.lit(k)).alias(f"a{k + 1}") for k in range(7)]


@query(f"SELECT vec_id // 10 AS episode_id, (count(*) OVER (PARTITION BY vec_id // 10))::INT AS steps, (row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) - 1)::INT AS step, label, {SEVEN} FROM embeddings")
def tfrecord_episodes(spark, d):
    """Episodes of vectors as sequence examples, a feature list for each step's action, read back by a narrower schema."""
    spark.dataSource.register(TfRecordSource)
    at = shared_folder(spark, "tfrecord")
    v = table(spark, d, "embeddings").withColumn("episode_id", (F.col("vec_id") / 10).cast("long"))
    steps = F.sort_array(F.collect_list(F.struct("vec_id", "embedding", "label")))
    whole = v.groupBy("episode_id").agg(steps.alias("s"))
    whole = whole.select("episode_id", F.size("s").alias("steps"), F.transform("s.embedding", lambda x: F.slice(x, 1, 7)).alias("actions"), F.col("s.label").alias("labels"), F.col("s.embedding").alias("unread"))
    whole.write.format("tfrecord").mode("append").save(at)
    got = spark.read.format("tfrecord").schema("episode_id long, steps int, actions array<array<double>>, labels array<int>").load(at)
    flat = got.select("episode_id", "steps", F.posexplode(F.arrays_zip("actions", "labels")).alias("step", "x"))
    return flat.select("episode_id", "steps", "step", F.col("x.labels").alias("label"), *seven("x.actions"))


@query(f"""SELECT vec_id // 50 AS episode_id, (vec_id % 50)::INT AS step, {SEVEN}, embedding[8]::DOUBLE AS gripper, label FROM embeddings""")
def hdf5_steps(spark, d):
    """Episodes of vectors written as array files, a data set a column, and read back as steps; one that no column names is left unread."""
    spark.dataSource.register(Hdf5Source)
    at = shared_folder(spark, "hdf5")
    v = table(spark, d, "embeddings").select((F.col("vec_id") / 50).cast("long").alias("episode_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    whole = v.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v", "label"))).alias("s"))
    arrays = {"action/cartesian_position": F.transform("s.v", lambda x: F.slice(x, 1, 7)), "observation/robot_state/gripper_position": F.transform("s.v", lambda x: x[7]), "observation/label": F.col("s.label"), "observation/unread": F.col("s.v")}
    whole.select("episode_id", *[c.alias(n) for n, c in arrays.items()]).write.format("hdf5").mode("append").save(at)
    schema = "episode_id string, step int, `action/cartesian_position` array<double>, `observation/robot_state/gripper_position` double, `observation/label` int"
    got = spark.read.format("hdf5").schema(schema).load(f"{at}/*/trajectory.h5")
    return got.toDF("episode_id", "step", "action", "gripper", "label").select(F.col("episode_id").cast("long").alias("episode_id"), "step", *seven("action"), "gripper", "label")


PART_CHOICES = "CASE p_size % 5 WHEN 0 THEN [p_type, 'b', 'c'] WHEN 1 THEN ['Yes', 'No ', 'x', 'y'] WHEN 2 THEN ['Yes', 'Yes', 'a', 'b'] WHEN 3 THEN []::VARCHAR[] ELSE [p_type, 'b', 'c', 'd', 'e'] END"


@query(f"""WITH i AS (SELECT {PART_CHOICES} AS c FROM part), j AS (SELECT len(c) AS n, len(c) = 5 OR (len(c) = 4 AND list_sort([trim(c[1]), trim(c[2])]) = ['No', 'Yes']) AS good FROM i)
 SELECT count(*) AS seen, count_if(good)::BIGINT AS taken, count_if(NOT good)::BIGINT AS rejected, count_if(n = 0)::BIGINT AS without_choices FROM j""")
def quarantine_figures(spark, d):
    """How many items of parts are well formed, told by the pass that writes them."""
    text = lambda *x: F.array(*[F.lit(v) for v in x])
    r = F.col("p_size") % 5
    choices = F.when(r == 0, F.array("p_type", F.lit("b"), F.lit("c"))).when(r == 1, text("Yes", "No ", "x", "y")).when(r == 2, text("Yes", "Yes", "a", "b")).when(r == 3, F.array().cast("array<string>")).otherwise(F.array("p_type", *map(F.lit, "bcde")))
    made = table(spark, d, "part").select(F.col("p_partkey").alias("episode_id"), F.lit(0).alias("step"), F.lit(1).alias("rank"), F.col("p_brand").alias("tag"), F.col("p_name").alias("question"), choices.alias("choices"))
    figures = Observation()
    items.finalize(made, figures=figures).write.parquet(shared_folder(spark, "items"))
    names = ("seen", "taken", "rejected", "without_choices")
    return spark.createDataFrame([tuple(figures.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id // 5 AS g, user_id FROM events)) AS episodes, user_id // 5 AS dataset, user_id AS episode_id, count(*)::INT AS items, count_if(event_id % 7 = 0)::INT AS images FROM events GROUP BY 2, 3""")
def item_folders(spark, d):
    """Every event as an item, every seventh with a picture: written as folders that show when the job is done, told by the manifest."""
    e = table(spark, d, "events").select((F.col("user_id") / 5).cast("long").alias("dataset"), F.col("user_id").alias("episode_id"), "event_id", "event_type", "value")
    rows = e.select("dataset", "episode_id", F.col("event_id").cast("int").alias("step"), F.lit(1).alias("rank"), F.col("event_type").alias("tag"), F.format_string("value %.3f?", "value").alias("question"), F.array(*map(F.lit, "abcde")).alias("choices"), F.lit(0).alias("correct_answer"), F.array(F.col("event_id").cast("string")).alias("image_ids"))
    pictures = e.where("event_id % 7 = 0").select("dataset", "episode_id", F.col("event_id").cast("string").alias("image_id"), F.col("event_type").cast("binary").alias("png"))
    told = e.groupBy("dataset", "episode_id").agg(F.max("event_type").alias("language_instruction"))
    at = shared_folder(spark, "folders")
    written = sinks.write_items(rows, pictures, told, at)
    found = episodes.read_items(spark, at).select("source_file").distinct().count()
    return written.select(F.lit(found).cast("long").alias("episodes"), F.col("dataset").cast("long").alias("dataset"), F.col("episode_id").cast("long").alias("episode_id"), "items", "images")


@query("""SELECT event_id, regexp_extract(props, '"k": *(-?[0-9]+)', 1)::BIGINT AS k, NULL::VARCHAR AS missing, 'OBJECT<k: BIGINT>' AS schema FROM events""")
def variant_props(spark, d):
    """Events' properties as VARIANT: a member, one that is missing, and the schema that all have in common."""
    e = table(spark, d, "events").select("event_id", nested.as_variant(F.col("props")).alias("v"))
    common = nested.schema_of(e, F.col("v"))
    return e.join(F.broadcast(common)).select("event_id", nested.walk(F.col("v"), "k", kind="bigint").alias("k"), nested.walk(F.col("v"), "k", "deeper", 0).alias("missing"), "schema")


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label::DOUBLE END AS gripper, CASE WHEN vec_id % 3 <> 0 THEN label END AS first_reading, CASE WHEN vec_id % 3 <> 0 THEN vec_id END AS second_reading,
 '[' || label || ']' AS told, label AS flat, vec_id AS apart FROM embeddings""")
def variant_steps(spark, d):
    """Nested readings whose number varies: arrays of one value are that value at any depth, others stay, brackets in texts too."""
    label, vec = F.col("label").cast("string"), F.col("vec_id").cast("string")
    readings = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("[["), label, F.lit("]]"))).otherwise(F.concat(F.lit("["), label, F.lit(", "), vec, F.lit("]")))
    json = F.concat(F.lit('{"state": {"gripper": '), readings, F.lit(', "told": ["['), label, F.lit(']"], "deep": {"flat": [[['), label, F.lit("]]]}}, \"pairs\": [["), label, F.lit("], ["), vec, F.lit("]]}"))
    v = table(spark, d, "embeddings").select("vec_id", nested.as_variant(json).alias("v"))
    at = lambda *path, kind: nested.walk(F.col("v"), *path, kind=kind)
    return v.select(
        "vec_id", at("state", "gripper", kind="double").alias("gripper"), at("state", "gripper", 0, kind="int").alias("first_reading"), at("state", "gripper", 1, kind="bigint").alias("second_reading"),
        at("state", "told", kind="string").alias("told"), at("state", "deep", "flat", kind="int").alias("flat"), at("pairs", 1, 0, kind="bigint").alias("apart"),
    )


SPANS = "CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 60000000 WHEN 2 THEN 3600000000 ELSE 30::BIGINT * 86400000000 + event_id END"


@query(f"""WITH s AS (SELECT event_id AS interval_id, user_id, epoch_us(ts) AS b, epoch_us(ts) + {SPANS} AS e FROM events WHERE event_type = 'signup')
 SELECT s.interval_id, count(*) AS readings, min(v.event_id) AS least, sum(v.event_id)::BIGINT AS total FROM events v JOIN s ON v.user_id = s.user_id AND epoch_us(v.ts) BETWEEN s.b AND s.e GROUP BY 1""")
def readings_in_intervals(spark, d):
    """Events inside the intervals that signups begin, from no time to a month, of the same user."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    r = F.col("event_id") % 4
    span = F.when(r == 0, 0).when(r == 1, 60_000_000).when(r == 2, 3_600_000_000).otherwise(F.lit(30 * 86_400_000_000) + F.col("event_id"))
    spans = e.where("event_type = 'signup'").select(F.col("event_id").alias("interval_id"), "user_id", F.col("at").alias("begin"), (F.col("at") + span).alias("end"))
    met = ranges.in_intervals(e.select("event_id", "user_id", "at"), spans, ["user_id"], "at", "begin", "end")
    return met.groupBy("interval_id").agg(F.count("*").alias("readings"), F.min("event_id").alias("least"), F.sum("event_id").alias("total"))


# Pictures of 8 x 8 grey pixels from the vectors.
GREY = "list_transform(embedding, lambda x: least(greatest(floor(x::DOUBLE * 128 + 128), 0), 255)::BIGINT)"


def grey(rows: DataFrame) -> DataFrame:
    """vec_id and the PNG file of each vector's picture."""
    byte = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 128 + 128), F.lit(0)), F.lit(255)))
    data = F.unhex(F.array_join(F.transform(byte, lambda b: F.lpad(F.hex(b), 2, "0")), ""))
    frames = rows.select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    return raster.encode_frames(frames).select("vec_id", "png")


@query(f"SELECT vec_id, 8 AS height, 8 AS width, sha256(array_to_string(list_transform({GREY}, lambda b: repeat(printf('%02x', b), 3)), '')) AS pixels FROM embeddings")
def decoded_pictures(spark, d):
    """Picture files in a column, back as pixels."""
    got = grey(table(spark, d, "embeddings")).select("vec_id", pictures.decoded(F.col("png")).alias("p"))
    return got.select("vec_id", "p.height", "p.width", F.sha2(F.lower(F.hex("p.data")).cast("binary"), 256).alias("pixels"))


def _taps(name: str, to: int) -> str:
    """Weights in fixed point from 8 samples to ``to``, as a relation (o, i, w)."""
    ratio, sinc = 8 / to, "CASE WHEN {0} = 0 THEN 1.0 ELSE sin(pi() * {0}) / (pi() * {0}) END"
    stretch = max(ratio, 1.0)
    return f"""{name}_raw AS (SELECT o, i, (i - (o + 0.5::DOUBLE) * {ratio}::DOUBLE + 0.5::DOUBLE) / {stretch}::DOUBLE AS x FROM range({to}) a(o), range(8) b(i)
  WHERE i >= greatest(trunc((o + 0.5::DOUBLE) * {ratio}::DOUBLE - {3 * stretch} + 0.5), 0) AND i < least(trunc((o + 0.5::DOUBLE) * {ratio}::DOUBLE + {3 * stretch} + 0.5), 8)),
 {name}_w AS (SELECT o, i, CASE WHEN abs(x) < 3 THEN ({sinc.format('x')}) * ({sinc.format('(x / 3)')}) ELSE 0 END AS w FROM {name}_raw),
 {name} AS (SELECT o, i, trunc(w / sum(w) OVER (PARTITION BY o) * 4194304 + CASE WHEN w < 0 THEN -0.5 ELSE 0.5 END)::BIGINT AS w FROM {name}_w)"""


@query(f"""WITH {_taps('tx', 5)}, {_taps('ty', 11)}, px AS (SELECT vec_id, unnest({GREY}) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
 across AS (SELECT vec_id, k // 8 AS y, o AS x, least(greatest((sum(v * w)::BIGINT + 2097152) >> 22, 0), 255) AS v FROM px JOIN tx ON tx.i = k % 8 GROUP BY ALL),
 down AS (SELECT vec_id, o AS y, x, least(greatest((sum(v * w)::BIGINT + 2097152) >> 22, 0), 255) AS v FROM across JOIN ty ON ty.i = y GROUP BY ALL)
 SELECT vec_id, sha256(string_agg(repeat(printf('%02x', v), 3), '' ORDER BY y, x)) AS pixels FROM down GROUP BY vec_id""")
def lanczos_pictures(spark, d):
    """Pictures made narrower and higher, 8 x 8 to 5 x 11, by kernels in fixed point."""

    @F.pandas_udf("binary")
    def resized(files: pd.Series) -> pd.Series:
        return pd.Series([pictures.lanczos(pictures.decode_png(b), 11, 5).tobytes() for b in files])

    return grey(table(spark, d, "embeddings")).select("vec_id", F.sha2(F.lower(F.hex(resized("png"))).cast("binary"), 256).alias("pixels"))


# Evaluation: the second stage and the cache as a table.


@query(r"""WITH m AS (SELECT conv_id, turn, role, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS response FROM conversations),
 f AS (SELECT *, regexp_extract_all(upper(response), '\b([A-E])\b', 1)[-1] AS l FROM m)
 SELECT conv_id, turn, coalesce(l, CASE WHEN response IS NOT NULL THEN chr((65 + length(response) % 5)::INT) END) AS letter, CASE WHEN l IS NULL AND response IS NOT NULL THEN 'second' ELSE 'first' END AS stage FROM f""")
def extracted_letters(spark, d):
    """Messages as responses: those without a letter of their own go to a second model, here one that answers by the response's length."""

    def load():
        demo = len(EXTRACTION_DEMO) + 2

        def answer(prompts):
            parts = [p[demo:].removesuffix("\n\nExtracted answer: ").split("\n\n", 1)[1] for p in prompts]
            return [f"It says {chr(65 + len(p) % 5)}." for p in parts]

        return answer

    m = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "_").alias("response"), F.lit("Which one?").alias("prompt"))
    return evaluate.settled(m, load).select("conv_id", "turn", F.col("predicted_letter").alias("letter"), "stage")


@query("""WITH a AS (SELECT 'm' || (o_custkey % 3) || '/x' AS model, o_orderkey::VARCHAR AS question_id, o_orderstatus AS letter, 1 AS run FROM orders UNION ALL
 SELECT 'm' || (o_custkey % 3) || '/x', o_orderkey::VARCHAR, 'Z', 2 FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey % 2 = 0), l AS (SELECT model, question_id, arg_max(letter, run) AS letter FROM a GROUP BY ALL)
 SELECT model, letter, count(*) AS questions, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey) AS misses FROM l GROUP BY ALL""")
def cache_table_runs(spark, d):
    """Two runs' answers in a keyed cache: the second replaces what it repeats; and how many line items ask what no run answered."""
    name, at = f"answers_{uuid.uuid4().hex}", shared_folder(spark, "cache")
    o = table(spark, d, "orders").select(F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string"), F.lit("/x")).alias("model"), F.col("o_orderkey").cast("string").alias("question_id"), F.col("o_orderstatus").alias("predicted_letter"))
    filled = o.select("*", F.lit("text").alias("predicted"), F.lit(1.0).alias("response_time"), F.lit(True).alias("correct"))
    cache_table.create(spark, name, at, 8)
    cache_table.store(filled, name, 8)
    cache_table.store(filled.where("model = 'm1/x' and cast(question_id as long) % 2 = 0").withColumn("predicted_letter", F.lit("Z")), name, 8)
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("question_id")).join(o.select("question_id", "model"), "question_id", "left").fillna("none", ["model"])
    open_ = cache_table.misses(asked, name).agg(F.count("*").alias("misses"))
    return spark.table(name).groupBy("model", F.col("predicted_letter").alias("letter")).agg(F.count("*").alias("questions")).join(F.broadcast(open_))


@query("""WITH r AS (SELECT 'm' || (o_custkey % 3) AS model, o_orderkey AS q, CASE WHEN o_orderkey % 7 > 0 THEN chr((65 + o_orderkey % 5)::INT) END AS l, o_orderstatus = 'F' AS c FROM orders),
 p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY q) AS place, count(*) OVER (PARTITION BY model) AS n FROM r),
 x AS (SELECT a.model AS model_a, b.model AS model_b, a.l IS DISTINCT FROM b.l AS d, a.c AS ca, b.c AS cb, a.n FROM p a JOIN p b ON a.place = b.place AND a.model < b.model)
 SELECT model_a, model_b, count(*) AS total, count_if(d)::BIGINT AS disagreements, count_if(d AND ca AND NOT cb)::BIGINT AS a_better, count_if(d AND cb AND NOT ca)::BIGINT AS b_better, count_if(d AND NOT ca AND NOT cb)::BIGINT AS both_wrong,
 count_if(d)::DOUBLE / any_value(n) * 100 AS percent FROM x GROUP BY ALL""")
def positional_disagreement(spark, d):
    """Three models' answers of different numbers, paired by place."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"), key.cast("string").alias("question_id"), key.alias("position"), F.when(key % 7 > 0, F.chr(65 + key % 5)).alias("predicted_letter"), (F.col("o_orderstatus") == "F").alias("correct"))
    return evaluation.disagreement_by_position(rows)


def noun_phrases(spark, d):
    """How many phrases whole documents hold, by role, and their heads; decoded by Viterbi, so held against all sequences of tags in tests."""
    found = table(spark, d, "documents").select("doc_id", phrases.noun_phrases(F.col("text")).alias("p"))
    of = lambda role: F.size(F.filter("p", lambda x: x["role"] == role)).alias(role)
    return found.select("doc_id", F.size("p").alias("phrases"), of("object"), of("place"), of("part"), F.sha2(F.array_join("p.head", " "), 256).alias("heads"))


QUERIES["noun_phrases"] = noun_phrases
