"""Registered queries of the smaller functions: ids, prompts, descriptions, geometry, calibration, joins and cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry as geo
from .functions import text as txt
from .operators import evaluation, items, raster, sequences, splits
from .plans import visualise
from .sources import catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(x) for x in values])


# Ids and names.


@query(r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_\-]', '_', 'g') AS trajectory, regexp_replace(url, '[^A-Za-z0-9_\-]', '_', 'g') || '_q' || (page_id + 1) AS id FROM pages")
def trajectory_ids(spark, d):
    return table(spark, d, "pages").select("page_id", txt.clean_trajectory_id(F.col("url")).alias("trajectory"), txt.unique_id(F.col("url"), F.col("page_id")).alias("id"))


MODELS = ("Qwen/Qwen2.5-VL-7B", "Qwen/Qwen2-VL:latest", "qwen/Qwen-VL", "llava-hf/llava-1.5-7b", "llava-hf/llava-v1.6-x", "org/LLaVA-NeXT", "meta/Llama-4-Scout", "meta/Llama-3.2-11B", "google/gemma-3-4b", "google/paligemma2-3b", "google/paligemma-3b", "microsoft/Phi-4-mm", "other/model")


@query(f"SELECT s_suppkey, m AS model, translate(m, '/:', '__') AS slug, CASE " + " ".join(f"WHEN contains(lower(m), '{part}') THEN '{name}'" for part, name in txt.MODEL_FAMILIES) + f" END AS family, concat_ws('::', m, s_suppkey::VARCHAR) AS key FROM (SELECT s_suppkey, {_list(MODELS)}[s_suppkey % {len(MODELS)} + 1] || ':' || s_name AS m FROM supplier)")
def model_names(spark, d):
    m = F.concat(F.get(_texts(*MODELS), F.col("s_suppkey") % len(MODELS)), F.lit(":"), "s_name")
    s = table(spark, d, "supplier").select("s_suppkey", m.alias("model"))
    return s.select("s_suppkey", "model", txt.model_slug(F.col("model")).alias("slug"), txt.model_family(F.col("model")).alias("family"), txt.cache_key(F.col("model"), F.col("s_suppkey").cast("string")).alias("key"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN '' END AS tag, CASE WHEN p_partkey % 5 <> 0 THEN p_type || '_' || p_partkey END AS id FROM part)
 SELECT p_partkey, coalesce(nullif(tag, ''), split_part(id, '_', 1), 'general') AS tag FROM t""")
def question_tags(spark, d):
    k = F.col("p_partkey")
    tag = F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, "")
    return table(spark, d, "part").select("p_partkey", txt.tag_of(tag, F.when(k % 5 != 0, F.concat_ws("_", "p_type", k.cast("string")))).alias("tag"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'unknown' ELSE n_name END AS dataset FROM nation")
def failure_datasets(spark, d):
    n = F.col("n_nationkey")
    status = F.when(n % 4 == 0, "no name here").otherwise(F.concat(F.lit("Failed to read ("), F.col("n_name"), F.lit(") twice (again)")))
    return table(spark, d, "nation").select("n_nationkey", txt.reason_dataset(status).alias("dataset"))


@query("SELECT source, CASE source WHEN 'src1' THEN 'bridge_dataset' WHEN 'src2' THEN 'robo_net' WHEN 'src3' THEN 'language_table' ELSE source END AS name, '/root/' || CASE source WHEN 'src1' THEN 'bridge_dataset/0.1.0' WHEN 'src2' THEN 'robo_net/1.0.0' WHEN 'src3' THEN 'language_table/0.0.1' ELSE source || '/0.1.0' END AS path, count(*) AS episodes FROM documents GROUP BY source")
def catalogue_paths(spark, d):
    name = F.when(F.col("source") == "src1", "bridge").when(F.col("source") == "src2", "robo_net").when(F.col("source") == "src3", "language_table").otherwise(F.col("source"))
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("episodes")).withColumn("name", catalogue.catalogue_name(name))
    return rows.select("source", "name", catalogue.catalogue_path(F.col("name"), "/root").alias("path"), "episodes")


_CONFIG = ", ".join(
    f"('{n}', [{', '.join(repr(x) for x in images if x)}]::VARCHAR[], {sum(x is not None for x in depths)}, {catalogue.PROPRIO[p]}, {catalogue.ACTION[a]})" for n, images, depths, p, a in catalogue.DATASETS
)


_CONFIGS = f"SELECT dataset, array_to_string(cameras, ',') AS cameras, depths::INT AS depths, proprio::INT AS proprio_encoding, action::INT AS action_encoding, dataset <> 'droid' AS swapped, CASE dataset " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in catalogue.CAPS.items()) + f" ELSE {catalogue.DEFAULT_CAP} END AS cap FROM (VALUES {_CONFIG}) v(dataset, cameras, depths, proprio, action)"
_DATASETS = [x[0] for x in catalogue.DATASETS]


@query(f"SELECT doc_id, c.* FROM documents JOIN ({_CONFIGS}) c ON c.dataset = {_list(_DATASETS)}[doc_id % {len(_DATASETS) + 2} + 1]")
def dataset_configs(spark, d):
    """Documents as episodes of the data sets, each with its data set's configuration; those of a data set that has none are left out."""
    c = catalogue.dataset_config(spark)
    depths = F.size(F.array_compact(F.array("depth_primary", "depth_secondary", "depth_wrist")))
    known = c.select("dataset", F.array_join("cameras", ",").alias("cameras"), depths.alias("depths"), "proprio_encoding", "action_encoding", catalogue.swapped_channels(F.col("dataset")).alias("swapped"), catalogue.cap_of(F.col("dataset")).alias("cap"))
    episodes = table(spark, d, "documents").select("doc_id", F.get(_texts(*_DATASETS), F.col("doc_id") % (len(_DATASETS) + 2)).alias("dataset"))
    return episodes.join(F.broadcast(known), "dataset").select("doc_id", *known.columns)


# Prompts, answers and descriptions.


@query(f"SELECT p_partkey, md5('{txt.EXTRACTION_DEMO.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || p_type || chr(10) || chr(10) || 'Extracted answer: ') AS prompt FROM part")
def extraction_prompts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.md5(txt.extraction_prompt(F.col("p_name"), F.col("p_type"))).alias("prompt"))


@query(r"SELECT conv_id, turn, regexp_extract_all(upper(x), '\b([A-E])\b', 1)[-1] AS letter FROM (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS x FROM conversations)")
def letter_bounded(spark, d):
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return table(spark, d, "conversations").select("conv_id", "turn", txt.letter_bounded(plain).alias("letter"))


_BY_WORD = "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{w}'" for w in txt.SCENES) + " ELSE '' END AS place, CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{w}'" for w in txt.TASKS) + " ELSE '' END AS task"


@query(f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN place ELSE '' END AS place, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN task ELSE '' END AS task, '' AS target, CASE WHEN turn % 3 = 0 THEN regexp_replace(text, '[{{}}]', '', 'g') ELSE '' END AS location
 FROM (SELECT conv_id, turn, role, text, {_BY_WORD} FROM conversations)""")
def descriptions(spark, d):
    """Messages as a vision model's answers: a third of them as JSON amid text, a third as plain text, a third with JSON that is cut off."""
    plain = F.regexp_replace("text", "[{}]", "")
    json = F.to_json(F.struct(F.col("role").alias("task"), plain.alias("location")))
    third = F.col("turn") % 3
    answer = F.when(third == 0, F.concat(F.lit("Here: "), json, F.lit(" as asked"))).when(third == 1, plain).otherwise(F.lit("{"))
    told = table(spark, d, "conversations").withColumn("x", txt.description(answer))
    return told.select("conv_id", "turn", F.col("x.physical_location").alias("place"), F.col("x.task").alias("task"), F.col("x.target_object").alias("target"), F.col("x.location").alias("location"))


_PLAIN = r"regexp_replace(lower(text), '[^\p{L}\p{N} ]', '', 'g')"


def _first_of_each(pattern: str) -> str:
    """Distinct matches in order of their first place, joined."""
    return rf"""SELECT doc_id, string_agg(x, ',' ORDER BY pos) AS found FROM (SELECT doc_id, x, min(pos) AS pos FROM (SELECT doc_id, unnest(m) AS x, generate_subscripts(m, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 1) AS m FROM spoken)) GROUP BY doc_id, x) GROUP BY doc_id"""


_SPOKEN = f"spoken AS (SELECT doc_id, coalesce({_PLAIN}, '') AS t FROM documents)"


@query(f"WITH {_SPOKEN}, n AS ({_first_of_each('(?:^| )(?:the|a|an) ([^ ]+)')}), p AS ({_first_of_each('(?:^| )(?:' + '|'.join(txt.PLACE_WORDS) + ') (?:the|a|an) ([^ ]+)')})"
       " SELECT s.doc_id, coalesce(n.found, regexp_extract(t, '([^ ]+) *$', 1)) AS nouns, coalesce(p.found, '') AS places FROM spoken s LEFT JOIN n ON n.doc_id = s.doc_id LEFT JOIN p ON p.doc_id = s.doc_id")  # fmt: skip
def noun_lists(spark, d):
    said = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.array_join(txt.nouns(said), ",").alias("nouns"), F.array_join(txt.places(said), ",").alias("places"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.none'), 'absent') AS other FROM events")
def nested_values(spark, d):
    return table(spark, d, "events").select("event_id", txt.safe_path(F.col("props"), "$.k").alias("k"), txt.safe_path(F.col("props"), "$.none", "absent").alias("other"))


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN turn % 2 = 0 THEN 'role=' || role END, CASE WHEN turn % 3 = 0 THEN 'vlm_role=' || role END) AS metadata FROM conversations""")
def enriched_metadata(spark, d):
    t = F.col("turn")
    own = F.when(t % 2 == 0, F.create_map(F.lit("role"), F.col("role")))
    seen = F.when(t % 3 == 0, F.create_map(F.lit("role"), F.col("role"), F.lit("blank"), F.lit(""), F.lit("none"), F.lit(None).cast("string")))
    pairs = F.array_sort(F.transform(F.map_entries(items.enriched(own, seen)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(pairs, ",").alias("metadata"))


@query("SELECT page_id, sha256(html) AS image_id, base64(encode(html)) AS content FROM pages")
def image_names(spark, d):
    b = F.col("html").cast("binary")
    return table(spark, d, "pages").select("page_id", F.sha2(b, 256).alias("image_id"), F.regexp_replace(F.base64(b), r"\r?\n", "").alias("content"))


# Geometry and layout.


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT vec_id, trunc(v[1] * 1000)::BIGINT AS x, trunc(v[2] * 1000)::BIGINT AS y, v[3] * 10 AS a, v[4] * 10 AS b FROM v)
 SELECT vec_id, trunc(x + 80 * cos(a))::BIGINT AS u, trunc(y + 80 * sin(a))::BIGINT AS v, round(least(abs(a - b), 6.283185307179586 - abs(a - b)), 6) AS gap, (x >= 20)::INT + 2 * (y >= 15)::INT AS quadrant, x >= 0 AND x < 41 AND y >= 0 AND y < 31 AS inside FROM p""")
def arrows_and_quadrants(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, d, "embeddings").select("vec_id", F.struct((e(0) * 1000).cast("long").alias("u"), (e(1) * 1000).cast("long").alias("v")).alias("p"), (e(2) * 10).alias("a"), (e(3) * 10).alias("b"))
    end, w, h = geo.arrow_end(F.col("p"), F.col("a")), F.lit(41), F.lit(31)
    return rows.select("vec_id", end["u"].alias("u"), end["v"].alias("v"), F.round(geo.angle_gap(F.col("a"), F.col("b")), 6).alias("gap"), geo.quadrant(F.col("p"), w, h).cast("int").alias("quadrant"), geo.in_image(F.col("p"), w, h).alias("inside"))


@query("SELECT p_partkey, CASE WHEN p_size % 9 + 1 <= 2 THEN 1 ELSE ceil((p_size % 9 + 1) / 2)::INT END AS grid_rows, CASE WHEN p_size % 9 + 1 <= 2 THEN p_size % 9 + 1 ELSE 2 END AS grid_columns FROM part")
def sheet_grids(spark, d):
    return table(spark, d, "part").withColumn("g", geo.grid(F.col("p_size") % 9 + 1)).select("p_partkey", F.col("g.rows").alias("grid_rows"), F.col("g.columns").alias("grid_columns"))


_POINTS = "points AS (SELECT vec_id // 10 AS episode_id, (vec_id % 10)::INT AS step, trunc(embedding[1]::DOUBLE * 1000)::BIGINT AS x, trunc(embedding[2]::DOUBLE * 1000)::BIGINT AS y, x >= 0 AND y >= 0 AS seen FROM embeddings)"


@query(f"WITH {_POINTS}, m AS (SELECT *, lag(CASE WHEN seen THEN x END) OVER w AS fx, lag(CASE WHEN seen THEN y END) OVER w AS fy, min(CASE WHEN seen THEN step END) OVER e AS first_, max(CASE WHEN seen THEN step END) OVER e AS last_ FROM points WINDOW w AS (PARTITION BY episode_id ORDER BY step), e AS (PARTITION BY episode_id))"
       " SELECT episode_id, step, fx AS from_u, fy AS from_v, x AS to_u, y AS to_v, step = first_ AS is_first, step = last_ AS is_last FROM m WHERE seen")  # fmt: skip
def trajectory_segments(spark, d):
    p = F.struct((F.col("embedding")[0].cast("double") * 1000).cast("long").alias("u"), (F.col("embedding")[1].cast("double") * 1000).cast("long").alias("v"))
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("episode_id"), (F.col("vec_id") % 10).cast("int").alias("step"), p.alias("p"))
    return raster.path_segments(rows, F.col("p"))


@query("""WITH v AS (SELECT vec_id // 10 AS episode_id, (vec_id % 10)::INT AS step, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
 f AS (SELECT *, coalesce(lead(x, 4) OVER w, last_value(x) OVER e) AS fx, coalesce(lead(y, 4) OVER w, last_value(y) OVER e) AS fy, coalesce(lead(x) OVER w, x) AS tx, coalesce(lead(y) OVER w, y) AS ty FROM v
  WINDOW w AS (PARTITION BY episode_id ORDER BY step), e AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
 SELECT episode_id, step, 'ext1' AS camera, trunc(100 * x / 2 + 50)::BIGINT AS u, trunc(100 * y / 2 + 40)::BIGINT AS v, trunc(100 * tx / 2 + 50)::BIGINT AS tu, trunc(100 * fx / 2 + 50)::BIGINT AS fu, trunc(100 * fy / 2 + 40)::BIGINT AS fv FROM f""")
def action_marks(spark, d):
    """A camera two units before the plane of motion."""
    e = lambda i: F.col("embedding")[i].cast("double")
    steps = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("episode_id"), (F.col("vec_id") % 10).cast("int").alias("step"), F.array(e(0), e(1), F.lit(0.0)).alias("pose"), F.lit(None).cast("array<double>").alias("target"))
    numbers = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    cameras = steps.select("episode_id").distinct().select("episode_id", F.lit("ext1").alias("camera"), numbers(0, 0, -2, 0, 0, 0).alias("extrinsics"), numbers(100, 0, 50, 0, 100, 40, 0, 0, 1).alias("intrinsics"))
    m = visualise.action_marks(steps, cameras, ahead=4)
    return m.select("episode_id", "step", "camera", F.col("current.u").alias("u"), F.col("current.v").alias("v"), F.col("target.u").alias("tu"), F.col("future.u").alias("fu"), F.col("future.v").alias("fv"))


# Joins and cuts.

_EVENT_STEPS = "s AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, event_type FROM events)"


def _event_steps(spark, d) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("episode_id"), (F.row_number().over(order) - 1).alias("step"), "event_type")


@query(f"WITH {_EVENT_STEPS} SELECT s.episode_id, coalesce(max(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 90 END), max(step) + 1)::INT AS length FROM s LEFT JOIN customer ON c_custkey = s.episode_id GROUP BY s.episode_id")
def trajectory_lengths(spark, d):
    told = table(spark, d, "customer").select(F.col("c_custkey").alias("episode_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 90).cast("int").alias("trajectory_length"))
    return sequences.lengths(_event_steps(spark, d).select("episode_id", "step"), told)


@query(f"""WITH {_EVENT_STEPS}, k AS (SELECT episode_id, min(step) AS k FROM s WHERE event_type = 'signup' AND episode_id % 2 = 0 GROUP BY 1), n AS (SELECT episode_id, max(step) + 1 AS n FROM s GROUP BY 1),
 f AS (SELECT episode_id, step, unnest(['wrist_cam', 'zed_2', 'zed_1']) AS camera FROM s), t AS (SELECT n.episode_id, coalesce(k, n // 2) AS step FROM n LEFT JOIN k ON k.episode_id = n.episode_id)
 SELECT f.episode_id, f.step, min(camera) FILTER (WHERE NOT contains(camera, 'wrist')) AS camera FROM f JOIN t ON t.episode_id = f.episode_id AND t.step = f.step GROUP BY ALL""")
def shown_frames(spark, d):
    s = _event_steps(spark, d)
    frames = s.select("episode_id", "step", F.explode(_texts("wrist_cam", "zed_2", "zed_1")).alias("camera"))
    keys = s.where("event_type = 'signup' and episode_id % 2 = 0")
    return sequences.frame_pick(frames, keys, sequences.lengths(s))


@query(f"WITH {_EVENT_STEPS} SELECT episode_id, step, event_type FROM s WHERE (episode_id, step) IN (SELECT DISTINCT user_id, event_id % 7 FROM events)")
def keyframe_frames(spark, d):
    keys = table(spark, d, "events").select(F.col("user_id").alias("episode_id"), (F.col("event_id") % 7).alias("step"))
    return raster.key_frames(_event_steps(spark, d), keys)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 300")
def head_by_position(spark, d):
    return splits.head(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 300, 16)


@query("SELECT 'checkpoint-' || max(o_orderkey) AS name FROM orders")
def latest_checkpoint(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("name"))
    return splits.latest(rows, F.regexp_extract("name", r"(\d+)$", 1).cast("long"), "name")


@query("SELECT p_partkey, CASE WHEN p_size = 0 AND p_partkey % 2 = 0 THEN 0.8 ELSE 0 END AS none_, round((p_size * 3.0::DOUBLE) / (p_size * 3 + p_partkey), 6) AS share FROM part WHERE p_partkey > 0")
def split_thresholds(spark, d):
    p = table(spark, d, "part").where("p_partkey > 0")
    none = F.when((F.col("p_size") == 0) & (F.col("p_partkey") % 2 == 0), splits.threshold(F.lit(0.0), F.lit(0.0))).otherwise(F.lit(0.0))
    return p.select("p_partkey", none.alias("none_"), F.round(splits.threshold(F.col("p_size") * 3.0, F.col("p_partkey").cast("double")), 6).alias("share"))


_SEEDED = "tags AS (SELECT unnest(['F', 'O', 'X']) AS tag)"


@query(f"WITH {_SEEDED}, r AS (SELECT l_linestatus AS tag, l_returnflag = 'N' AS c FROM lineitem) SELECT t.tag, count(c) AS total, coalesce(sum(c::INT), 0)::BIGINT AS hits, CASE WHEN count(c) > 0 THEN sum(c::INT)::DOUBLE / count(c) * 100 ELSE 0.0::DOUBLE END AS accuracy FROM tags t LEFT JOIN r ON r.tag = t.tag GROUP BY t.tag")
def accuracy_of_seeded_tags(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("tag"), (F.col("l_returnflag") == "N").alias("correct"), F.lit(1.0).alias("response_time"))
    return evaluation.accuracy_by_tag(r, spark.createDataFrame([("F",), ("O",), ("X",)], "tag string")).drop("mean_time")


@query("SELECT n_name AS dataset, o_orderkey AS episode_id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'F'")
def failed_episodes(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("success")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    return evaluation.failures(o.select(F.col("n_name").alias("dataset"), F.col("o_orderkey").alias("episode_id"), "success")).drop("success")


@query("""WITH c AS (SELECT l_orderkey::VARCHAR AS q, max(l_returnflag) AS letter FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), o AS (SELECT o_orderkey::VARCHAR AS q FROM orders)
 SELECT o.q AS question_id, coalesce(c.letter, 'N') AS letter, c.q IS NOT NULL AS from_cache FROM o LEFT JOIN c ON c.q = o.q""")
def merged_cache(spark, d):
    cases = table(spark, d, "orders").select(F.lit("m").alias("model"), F.col("o_orderkey").cast("string").alias("question_id"))
    held = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").cast("string").alias("question_id")).agg(F.max("l_returnflag").alias("letter")).withColumn("model", F.lit("m"))
    answered = evaluation.cache_misses(cases, held).withColumn("letter", F.lit("N"))
    return evaluation.merge_cache(cases, held, answered).select("question_id", "letter", "from_cache")
