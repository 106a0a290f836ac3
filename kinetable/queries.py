"""Registered queries: each operator applied to whole tables, with its oracle in plain SQL.

The tables stand for the domain's: ``events`` are episode steps (user = episode, value = gripper),
``documents`` give instructions and sources, ``embeddings`` are action, state and pose vectors,
``part`` gives question items, ``lineitem`` and ``orders`` responses, ``pages`` paths.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import helper_queries, source_queries
from .functions import geometry as geo
from .functions import text as txt
from .functions import vectors as vec
from .functions.hashing import digest, draw
from .operators import evaluation, items, phases, sequences, splits
from .operators.standardize import standardize
from .plans import generation
from .sources import catalogue, episodes
from .transform_queries import oracle_sql as transforms_sql
from .transform_queries import standardize_all as all_transforms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bindings: the same relations in both forms.


def steps(spark, d) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("episode_id"), (F.row_number().over(order) - 1).alias("step"), F.col("value").alias("gripper"))


def about(spark, d) -> DataFrame:
    """episode_id, instruction, path of every episode: a whole document's text, a made-up path."""
    e = table(spark, d, "events").select(F.col("user_id").alias("episode_id")).distinct()
    return e.join(_texts(spark, d), "episode_id", "left").select("episode_id", F.coalesce("instruction", F.lit("pick up the block")).alias("instruction"), _path(F.col("episode_id")).alias("path"))


def _texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("episode_id"), F.lower("text").alias("instruction"))


def _path(e: Column) -> Column:
    return F.concat(F.lit("store/droid_raw/1.0.1/"), F.when(e % 2 == 0, "success").otherwise("failure"), F.lit("/ep"), e.cast("string"), F.lit("/trajectory.h5"))


def vectors(spark, d) -> DataFrame:
    """episode_id (ten vectors an episode), step, v (doubles)."""
    v = table(spark, d, "embeddings")
    return v.select((F.floor(F.col("vec_id") / 10)).cast("long").alias("episode_id"), (F.col("vec_id") % 10).cast("int").alias("step"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


STEPS = "steps AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value AS gripper FROM events)"
NORM = STEPS + """, norm AS (SELECT episode_id, step, gripper, (gripper - lo) / (hi - lo + 1e-6::DOUBLE) AS g FROM
 (SELECT *, greatest(-1.0::DOUBLE, max(gripper) OVER w) AS hi, least(1.0::DOUBLE, min(gripper) OVER w) AS lo FROM steps WINDOW w AS (PARTITION BY episode_id)))"""
PH = "WITH RECURSIVE " + NORM + """, ph AS (SELECT episode_id, step, g, 'pre_grasp' AS phase FROM norm WHERE step = 0 UNION ALL
 SELECT n.episode_id, n.step, n.g, CASE
  WHEN p.phase = 'pre_grasp' AND n.g > 0.2 AND n.g > p.g THEN 'immobilization'
  WHEN p.phase = 'immobilization' AND n.g >= 0.9 THEN 'contact'
  WHEN p.phase = 'immobilization' AND n.g <= 0.2 AND n.g < p.g THEN 'pre_grasp'
  WHEN p.phase = 'contact' AND n.g < 0.9 AND n.g < p.g THEN 'detach'
  WHEN p.phase = 'detach' AND n.g <= 0.2 THEN 'post_grasp'
  WHEN p.phase = 'detach' AND n.g >= 0.9 AND n.g > p.g THEN 'contact'
  WHEN p.phase = 'post_grasp' AND n.g > 0.2 AND n.g > p.g THEN 'immobilization'
  ELSE p.phase END FROM ph p JOIN norm n ON n.episode_id = p.episode_id AND n.step = p.step + 1)"""
RUNS = PH + """, marked AS (SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY episode_id ORDER BY step) = phase THEN 0 ELSE 1 END AS fresh FROM ph),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY episode_id ORDER BY step) AS run FROM marked),
 runs AS (SELECT episode_id, min(step) AS s, max(step) AS e, any_value(phase) AS phase FROM numbered GROUP BY episode_id, run)"""


def _h(seed: str, *key: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', '" + seed + "', " + ", ".join(f"({k})::VARCHAR" for k in key) + ")), 1, 8))::BIGINT"


KEYS = RUNS + f""", keys AS (SELECT DISTINCT episode_id, step FROM (
 SELECT episode_id, CASE WHEN e = s THEN s ELSE s + {_h('keyframe', 'episode_id', 's')} % (e - s) END AS step FROM runs
 UNION ALL SELECT DISTINCT episode_id, 0 FROM runs UNION ALL SELECT episode_id, max(e) FROM runs GROUP BY episode_id))"""
ABOUT = """about AS (SELECT e.episode_id, coalesce(lower(d.text), 'pick up the block') AS instruction,
 'store/droid_raw/1.0.1/' || CASE WHEN e.episode_id % 2 = 0 THEN 'success' ELSE 'failure' END || '/ep' || e.episode_id || '/trajectory.h5' AS path
 FROM (SELECT DISTINCT user_id AS episode_id FROM events) e LEFT JOIN documents d ON d.doc_id = e.episode_id)"""
NOUN = """coalesce(nullif(regexp_extract(regexp_replace(lower(instruction), '[^\\p{L}\\p{N} ]', '', 'g'), '(?:^| )(?:the|a|an) ([^ ]+)', 1), ''),
 nullif(regexp_extract(regexp_replace(lower(instruction), '[^\\p{L}\\p{N} ]', '', 'g'), '([^ ]+) *$', 1), ''))"""
VECTORS = "vectors AS (SELECT vec_id // 10 AS episode_id, vec_id % 10 AS step, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


# Sequence operators.


@query("WITH " + NORM + " SELECT episode_id, step, g FROM norm")
def gripper_normalize(spark, d):
    return phases.normalize(steps(spark, d)).select("episode_id", "step", "g")


@query(PH + " SELECT episode_id, step, phase FROM ph")
def grasp_phases(spark, d):
    return phases.phase_steps(phases.phase_runs(steps(spark, d)))


@query(PH + " SELECT episode_id, step, phase FROM ph")
def grasp_phases_blocked(spark, d):
    return phases.phase_steps(phases.phase_runs_blocked(steps(spark, d), block=32))


@query(RUNS + ' SELECT episode_id, s AS "start", e AS "end", phase FROM runs')
def phase_ranges(spark, d):
    return phases.phase_runs(steps(spark, d))


@query(PH + """, want AS (SELECT DISTINCT episode_id, unnest([-1, 0, 5, 60, 80, 1000]) AS step FROM steps), n AS (SELECT episode_id, max(step) + 1 AS n FROM steps GROUP BY 1)
 SELECT w.episode_id, w.step, coalesce(phase, CASE WHEN w.step < 0 OR w.step >= n THEN 'out_of_range' END, 'unknown') AS phase
 FROM want w LEFT JOIN ph ON ph.episode_id = w.episode_id AND ph.step = w.step LEFT JOIN n ON n.episode_id = w.episode_id""")
def step_phase_lookup(spark, d):
    s = steps(spark, d)
    want = s.select("episode_id").distinct().select("episode_id", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 5, 60, 80, 1000)])).alias("step"))
    return phases.phase_lookup(want, phases.phase_runs(s), sequences.lengths(s))


@query(KEYS + " SELECT episode_id, step FROM keys")
def keyframes(spark, d):
    return sequences.keyframes(phases.phase_runs(steps(spark, d)))


@query(RUNS + " SELECT phase, count(*) AS runs, sum(e - s + 1)::BIGINT AS steps, max(e - s + 1) AS longest FROM runs GROUP BY phase")
def phase_durations(spark, d):
    size = F.col("end") - F.col("start") + 1
    return phases.phase_runs(steps(spark, d)).groupBy("phase").agg(F.count("*").alias("runs"), F.sum(size).alias("steps"), F.max(size).alias("longest"))


@query(RUNS + " SELECT ph.episode_id, step, step >= last AS in_last FROM ph JOIN (SELECT episode_id, max(s) AS last FROM runs GROUP BY 1) l ON l.episode_id = ph.episode_id")
def in_last_phase(spark, d):
    runs = phases.phase_runs(steps(spark, d))
    last = runs.groupBy("episode_id").agg(F.max("start").alias("last"))
    return phases.phase_steps(runs).join(last, "episode_id").select("episode_id", "step", (F.col("step") >= F.col("last")).alias("in_last"))


@query("WITH " + STEPS + ", n AS (SELECT episode_id, max(step) + 1 AS n FROM steps GROUP BY 1) SELECT s.episode_id, step, least(step + 10, n - 1) AS ahead, CASE WHEN n > 1 THEN floor(255 * step / (n - 1))::BIGINT ELSE 0 END AS red FROM steps s JOIN n ON n.episode_id = s.episode_id")
def future_steps(spark, d):
    n = F.count("*").over(phases.episode())
    red, _ = sequences.gradient(F.col("step"), F.col("n"))
    return steps(spark, d).withColumn("n", n).select("episode_id", "step", sequences.future_step(F.col("step"), 10, F.col("n")).alias("ahead"), red.alias("red"))


@query("WITH " + NORM + """ SELECT episode_id, step, coalesce(first_value(CASE WHEN g > 0.95 THEN 1.0 WHEN g < 0.05 THEN 0.0 END IGNORE NULLS) OVER w, last_value(g) OVER w)::DOUBLE AS open
 FROM norm WINDOW w AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def binarize_actions(spark, d):
    return sequences.binarize(phases.normalize(steps(spark, d)), "g").select("episode_id", "step", "open")


@query("WITH " + STEPS + """, r AS (SELECT episode_id, step, gripper - lag(gripper) OVER (PARTITION BY episode_id ORDER BY step) AS x FROM steps)
 SELECT episode_id, coalesce(arg_min(CASE WHEN x < -1e-3 THEN 1.0 ELSE 0.0 END, step) FILTER (WHERE abs(x) > 1e-3), 0.0)::DOUBLE AS initial FROM r GROUP BY episode_id""")
def initial_open_state(spark, d):
    change = F.col("gripper") - F.lag("gripper").over(phases.episode("step"))
    return sequences.relative_to_absolute_start(steps(spark, d).withColumn("gripper", change))


@query("WITH " + STEPS + " SELECT episode_id, step // 3 AS step, gripper FROM steps WHERE step % 3 = 0")
def subsample_k(spark, d):
    return sequences.subsample(steps(spark, d), 3).select("episode_id", "step", "gripper")


# Vectors.


def _flat(rows: DataFrame, n: int) -> DataFrame:
    """Vector columns as one column an entry."""
    return rows.select("episode_id", "step", *[vec.item(F.col("action"), i).alias(f"a{i}") for i in range(n)])


def _sql_flat(expression: str, n: int, source: str = "vectors") -> str:
    return f"WITH {VECTORS}, t AS (SELECT episode_id, step, {expression} AS a FROM {source}) SELECT episode_id, step, " + ", ".join(f"a[{i + 1}] AS a{i}" for i in range(n)) + " FROM t"


@query("WITH " + VECTORS + """, t AS (SELECT episode_id, step, v, lead(v) OVER (PARTITION BY episode_id ORDER BY step) AS w FROM vectors)
 SELECT episode_id, step, w[1] - v[1] AS a0, w[2] - v[2] AS a1, w[3] - v[3] AS a2, w[4] - v[4] AS a3, w[5] - v[5] AS a4, w[6] - v[6] AS a5, v[64] AS a6 FROM t WHERE w IS NOT NULL""")
def relabel_actions(spark, d):
    v = vectors(spark, d).withColumn("action", F.col("v")).withColumnRenamed("v", "state")
    return _flat(sequences.relabel_actions(v), 7)


@query(_sql_flat("list_concat(v[1:3], [0.0, 0.0, 0.0], v[64:64])", 7))
def standardize_action_slice(spark, d):
    v = vectors(spark, d).withColumn("action", F.col("v")).withColumnRenamed("v", "state")
    return _flat(standardize(v, "ucsd_pick_and_place_dataset_converted_externally_to_rlds"), 7)


@query(_sql_flat("list_concat(v[1:6], [1.0 - greatest(least(v[64], 1.0), 0.0)])", 7))
def standardize_action_clip_invert(spark, d):
    v = vectors(spark, d).withColumn("action", F.col("v")).withColumnRenamed("v", "state")
    return _flat(standardize(v, "austin_sailor_dataset_converted_externally_to_rlds"), 7)


@query(_sql_flat("list_concat(v, list_transform(v, lambda x: 0.0), list_transform(v, lambda x: 0.0), [1.0])[62:66]", 5))
def standardize_action_concat(spark, d):
    v = vectors(spark, d).withColumn("action", F.col("v")).withColumnRenamed("v", "effector_translation").withColumn("instruction_codes", F.array(F.lit(104), F.lit(105), F.lit(0), F.lit(106)))
    done = standardize(v, "language_table")
    return _flat(done.withColumn("action", F.slice("action", 62, 5)), 5)


_Q = "v[4] * v[4] + v[5] * v[5] + v[6] * v[6] + v[7] * v[7]"


@query(f"""WITH {VECTORS} SELECT episode_id, step, round(atan2(2.0 * (v[7] * v[4] + v[5] * v[6]) / ({_Q}), 1.0 - 2.0 * (v[4] * v[4] + v[5] * v[5]) / ({_Q})), 6) AS roll,
 round(asin(least(greatest(2.0 * (v[7] * v[5] - v[6] * v[4]) / ({_Q}), -1.0), 1.0)), 6) AS pitch, round(atan2(2.0 * (v[7] * v[6] + v[4] * v[5]) / ({_Q}), 1.0 - 2.0 * (v[5] * v[5] + v[6] * v[6]) / ({_Q})), 6) AS yaw FROM vectors""")
def quat_to_euler(spark, d):
    v = vectors(spark, d).withColumn("action", F.col("v")).withColumnRenamed("v", "state")
    a = F.col("action")
    done = standardize(v, "iamlab_cmu_pickup_insert_converted_externally_to_rlds")
    return done.select("episode_id", "step", *[F.round(vec.item(a, 3 + i), 6).alias(n) for i, n in enumerate(("roll", "pitch", "yaw"))])


@query("WITH " + VECTORS + """, f AS (SELECT *, sqrt(first_value(v[4]) OVER w * first_value(v[4]) OVER w + first_value(v[5]) OVER w * first_value(v[5]) OVER w) AS top,
 nth_value(v[1], 2) OVER w - first_value(v[1]) OVER w AS fx, nth_value(v[2], 2) OVER w - first_value(v[2]) OVER w AS fy FROM vectors
 WINDOW w AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 k AS (SELECT episode_id, step // 3 AS step, v, top / sqrt(fx * fx + fy * fy) AS scale, lead(v) OVER (PARTITION BY episode_id ORDER BY step) AS w FROM f WHERE step % 3 = 0)
 SELECT episode_id, step, round(((w[1] - v[1]) * cos(v[3]) + (w[2] - v[2]) * sin(v[3])) * scale, 6) AS wx, round(((w[2] - v[2]) * cos(v[3]) - (w[1] - v[1]) * sin(v[3])) * scale, 6) AS wy FROM k WHERE w IS NOT NULL""")
def gnm_waypoints(spark, d):
    v = F.col("v")
    flat = vectors(spark, d).select("episode_id", "step", vec.item(v, 0).alias("x"), vec.item(v, 1).alias("y"), vec.item(v, 2).alias("yaw"), vec.item(v, 3).alias("ax"), vec.item(v, 4).alias("ay"))
    return sequences.gnm_waypoints(flat).select("episode_id", "step", F.round("wx", 6).alias("wx"), F.round("wy", 6).alias("wy"))


@query(transforms_sql(VECTORS))
def standardize_all(spark, d):
    """All 58 transforms: sizes and weighted sums of what they make."""
    return all_transforms(vectors(spark, d))


# Geometry: the camera is entries 7-12 of a vector, its matrix fixed.

FX, CX, CY = 733.37261963, 625.26251221, 361.92279053


def _k() -> Column:
    return F.array(*[F.lit(x) for x in (FX, 0.0, CX, 0.0, FX, CY, 0.0, 0.0, 1.0)])


def _pixel(point: str, camera: str) -> str:
    """SQL for the camera point's columns px, py, pz."""
    dx, dy, dz = (f"({point}[{i}] - {camera}[{i}])" for i in (1, 2, 3))
    c = [f"cos({camera}[{i}])" for i in (4, 5, 6)]
    s = [f"sin({camera}[{i}])" for i in (4, 5, 6)]
    return f"""({c[2]} * {c[1]} * {dx} + {s[2]} * {c[1]} * {dy} + (-{s[1]}) * {dz}) AS px,
 (({c[2]} * {s[1]} * {s[0]} - {s[2]} * {c[0]}) * {dx} + ({s[2]} * {s[1]} * {s[0]} + {c[2]} * {c[0]}) * {dy} + {c[1]} * {s[0]} * {dz}) AS py,
 (({c[2]} * {s[1]} * {c[0]} + {s[2]} * {s[0]}) * {dx} + ({s[2]} * {s[1]} * {c[0]} - {c[2]} * {s[0]}) * {dy} + {c[1]} * {c[0]} * {dz}) AS pz"""


_UV = f"CASE WHEN pz > 0 THEN trunc({FX} * (px / pz) + {CX})::BIGINT ELSE -1 END AS u, CASE WHEN pz > 0 THEN trunc({FX} * (py / pz) + {CY})::BIGINT ELSE -1 END AS v"


@query(f"WITH {VECTORS}, p AS (SELECT episode_id, step, {_pixel('v[1:3]', 'v[7:12]')} FROM vectors) SELECT episode_id, step, {_UV} FROM p")
def project_points(spark, d):
    v = F.col("v")
    pixel = geo.project(F.slice(v, 1, 3), F.slice(v, 7, 6), _k())
    return vectors(spark, d).withColumn("p", pixel).select("episode_id", "step", "p.u", "p.v")


@query(f"""WITH {VECTORS}, a AS (SELECT episode_id, step, v, {_pixel('v[1:3]', 'v[7:12]')} FROM vectors), b AS (SELECT episode_id, step, {_UV}, v AS vec FROM a),
 c AS (SELECT episode_id, step, u AS u1, v AS v1, {_pixel('vec[1:3]', 'vec[13:18]')} FROM b), e AS (SELECT episode_id, step, u1, v1, {_UV} FROM c)
 SELECT episode_id, step, u1, v1, u AS u2, v AS v2, ((u >= 640)::INT + 2 * (v >= 360)::INT)::BIGINT AS quadrant FROM e WHERE u1 >= 0 AND u1 < 1280 AND v1 >= 0 AND v1 < 720 AND u >= 0 AND u < 1280 AND v >= 0 AND v < 720""")
def camera_pair_correspondence(spark, d):
    v, k, w, h = F.col("v"), _k(), F.lit(1280), F.lit(720)
    both = vectors(spark, d).withColumns({"p": geo.pixel_of(F.slice(v, 1, 3), F.slice(v, 7, 6), k), "q": geo.pixel_of(F.slice(v, 1, 3), F.slice(v, 13, 6), k)})
    inside = both.where(geo.in_image(F.col("p"), w, h) & geo.in_image(F.col("q"), w, h))
    return inside.select("episode_id", "step", F.col("p.u").alias("u1"), F.col("p.v").alias("v1"), F.col("q.u").alias("u2"), F.col("q.v").alias("v2"), geo.quadrant(F.col("q"), w, h).cast("long").alias("quadrant"))


@query(f"""WITH {VECTORS}, a AS (SELECT episode_id, step, v AS vec, first_value(v) OVER (PARTITION BY episode_id ORDER BY step) AS cam, lead(v) OVER (PARTITION BY episode_id ORDER BY step) AS nxt FROM vectors),
 p AS (SELECT episode_id, step, cam, nxt, {_pixel('vec[1:3]', 'cam[7:12]')} FROM a WHERE nxt IS NOT NULL), p2 AS (SELECT episode_id, step, cam, nxt, {_UV} FROM p),
 q AS (SELECT episode_id, step, u AS u1, v AS v1, {_pixel('nxt[1:3]', 'cam[7:12]')} FROM p2), r AS (SELECT episode_id, step, u1, v1, {_UV} FROM q)
 SELECT episode_id, step, u1, v1, u AS u2, v AS v2, round(atan2((v - v1)::DOUBLE, (u - u1)::DOUBLE), 6) AS angle FROM r WHERE u1 >= 0 AND v1 >= 0 AND u >= 0 AND v >= 0""")
def action_direction(spark, d):
    return _headings(spark, d).withColumn("angle", F.round("angle", 6))


def _headings(spark, d) -> DataFrame:
    """Pixels of each position and the next in the first camera, and the angle between."""
    order = phases.episode("step")
    v = vectors(spark, d).withColumns({"cam": F.slice(F.first("v").over(order), 7, 6), "next": F.lead("v").over(order)}).where("next is not null")
    both = v.withColumns({"p": geo.pixel_of(F.slice("v", 1, 3), F.col("cam"), _k()), "q": geo.pixel_of(F.slice("next", 1, 3), F.col("cam"), _k())}).where("p.u >= 0 and p.v >= 0 and q.u >= 0 and q.v >= 0")
    angle = F.atan2((F.col("q.v") - F.col("p.v")).cast("double"), (F.col("q.u") - F.col("p.u")).cast("double"))
    return both.select("episode_id", "step", F.col("p.u").alias("u1"), F.col("p.v").alias("v1"), F.col("q.u").alias("u2"), F.col("q.v").alias("v2"), angle.alias("angle"))


def _direction(size: str, most: str) -> str:
    return f"""CASE WHEN d[3] > 0 THEN 'Upper' ELSE 'Lower' END || CASE WHEN {size}[1] > 0.4 * {most} OR {size}[2] > 0.4 * {most} THEN
 CASE WHEN {size}[1] > {size}[2] THEN CASE WHEN d[1] > 0 THEN ' Right' ELSE ' Left' END ELSE CASE WHEN d[2] > 0 THEN ' Forward' ELSE ' Backward' END END ELSE '' END"""


@query(f"""WITH {VECTORS}, t AS (SELECT episode_id, step, v, first_value(v) OVER (PARTITION BY episode_id ORDER BY step) AS z FROM vectors),
 u AS (SELECT episode_id, step, [v[1] - z[1], v[2] - z[2], v[3] - z[3], v[4] - z[4], v[5] - z[5], v[6] - z[6]] AS d FROM t), w AS (SELECT *, [abs(d[1]), abs(d[2]), abs(d[3])] AS a FROM u)
 SELECT episode_id, step, {_direction('a', 'list_max(a)')} AS fixed, {_direction('d', 'list_max(d)')} AS compat FROM w""")
def relative_direction(spark, d):
    order = phases.episode("step")
    v = vectors(spark, d).withColumn("d", vec.subtract(F.slice("v", 1, 6), F.slice(F.first("v").over(order), 1, 6)))
    return v.select("episode_id", "step", geo.direction_label(F.col("d"), signed=False).alias("fixed"), geo.direction_label(F.col("d"), signed=True).alias("compat"))


_TRIES = "CASE WHEN i <= 100 THEN 0.05 WHEN i <= 200 THEN 0.02 ELSE 0.01 END::DOUBLE"
#: Greedy choice of five depths: relation five_ (episode_id, ds).
FIVE = f"""points_ AS (SELECT episode_id, list(z ORDER BY k) AS zs FROM (SELECT episode_id, abs(z) * 5 AS z, md5(concat_ws('|', 'depth', episode_id::VARCHAR, step::VARCHAR, (x - 1)::VARCHAR)) AS k FROM (SELECT episode_id, step, unnest(v) AS z, generate_subscripts(v, 1) AS x FROM vectors)) WHERE z > 0.1 AND z < 5.0 GROUP BY episode_id HAVING count(*) >= 100),
 walk_ AS (SELECT episode_id, zs, 0 AS i, []::DOUBLE[] AS ds FROM points_ UNION ALL
  SELECT episode_id, zs, i + 1, CASE WHEN len(ds) < 5 AND i < len(zs) AND len(list_filter(ds, lambda q: abs(q - zs[i + 1]) < {_TRIES.replace('i <=', 'i <')})) = 0 THEN list_append(ds, zs[i + 1]) ELSE ds END FROM walk_ WHERE i < 300),
 five_ AS (SELECT episode_id, ds FROM walk_ WHERE i = 300 AND len(ds) = 5)"""


def _five(spark, d) -> DataFrame:
    """episode_id, five: depths apart, drawn from an episode's entries as depth pixels."""
    v = vectors(spark, d).select("episode_id", "step", F.posexplode("v").alias("x", "z")).withColumn("depth", F.abs("z") * 5)
    valid = v.where("depth > 0.1 and depth < 5.0")
    point = F.struct(digest("depth", F.col("episode_id"), F.col("step"), F.col("x")).alias("k"), F.struct("depth", F.col("x").alias("x"), F.col("step").alias("y")).alias("p"))
    drawn = valid.groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["p"]).alias("points")).where(F.size("points") >= 100)
    return drawn.select("episode_id", items.spaced_depths(F.col("points")).alias("five")).where(F.size("five") == 5)


@query("WITH RECURSIVE " + VECTORS + ", " + FIVE + f""" SELECT episode_id, ask AS asks_closest, ['Red', 'Green', 'Blue', 'Yellow', 'Purple'][list_position(ds, CASE WHEN ask THEN list_min(ds) ELSE list_max(ds) END)] AS answer
 FROM (SELECT *, {_h('ask', 'episode_id')} % 2 = 0 AS ask FROM five_)""")
def relative_depth(spark, d):
    """Five depths apart; which is the closest or farthest."""
    found = _five(spark, d)
    depths = F.transform("five", lambda p: p["depth"])
    closest = draw("ask", F.col("episode_id")) % 2 == 0
    at = F.array_position(depths, F.when(closest, F.array_min(depths)).otherwise(F.array_max(depths)))
    return found.select("episode_id", closest.alias("asks_closest"), F.element_at(F.array(*[F.lit(x) for x in items.COLOURS]), at.cast("int")).alias("answer"))


_HEADINGS = ORACLE_SQL["action_direction"].replace("round(atan2((v - v1)::DOUBLE, (u - u1)::DOUBLE), 6) AS angle", "atan2((v - v1)::DOUBLE, (u - u1)::DOUBLE) AS angle")


@query("WITH RECURSIVE heads AS (" + _HEADINGS + f"""), spin AS (SELECT episode_id, step, 0 AS i, [angle] AS found FROM heads UNION ALL
 SELECT episode_id, step, i + 1, CASE WHEN len(found) < 5 AND len(list_filter(found, lambda b: least(abs(x - b), {2 * math.pi} - abs(x - b)) < {math.radians(30)})) = 0 THEN list_append(found, x) ELSE found END
 FROM (SELECT *, {_h('arrow', 'episode_id', 'step', "'ext1'", 'i')} / 4294967296.0::DOUBLE * {2 * math.pi} AS x FROM spin WHERE i <= 60))
 SELECT episode_id, step, len(found)::INT AS arrows, {', '.join(f'round(found[{i + 1}], 6) AS angle{i}' for i in range(5))} FROM spin WHERE i = 61""")
def arrow_alternatives(spark, d):
    """Five headings at least 30 degrees apart, the true one first."""
    a = _headings(spark, d).withColumn("all", generation.arrows(F.col("angle"), F.lit("ext1")))
    return a.select("episode_id", "step", F.size("all").alias("arrows"), *[F.round(F.try_element_at("all", F.lit(i + 1)), 6).alias(f"angle{i}") for i in range(5)])


# Question items.


def _keys(spark, d) -> DataFrame:
    """Keyframes with g, phase, the last run's start, instruction and path."""
    return generation.keyed_steps(steps(spark, d), about(spark, d))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("episode_id", "step", "question", F.array_join("choices", " | ").alias("choices"))


KEYED = KEYS + ", " + ABOUT + """, full_ AS (SELECT k.episode_id, k.step, n.g, ph.phase, l.last_start, l.last, a.instruction, a.path FROM keys k JOIN norm n ON n.episode_id = k.episode_id AND n.step = k.step
 JOIN ph ON ph.episode_id = k.episode_id AND ph.step = k.step JOIN (SELECT episode_id, max(s) AS last_start, max(e) AS last FROM runs GROUP BY 1) l ON l.episode_id = k.episode_id JOIN about a ON a.episode_id = k.episode_id)"""


def _yes(cond: str, rest: str) -> str:
    return f"CASE WHEN {cond} THEN 'Yes | No' ELSE 'No | Yes' END || ' | {rest}'"


def _phrase_sql(phase: str) -> str:
    return f"CASE {phase} " + " ".join(f"WHEN '{p}' THEN '{a}' || target || '{b}'" for p, (a, b) in items.PHASE_PHRASES.items()) + " END"


def _phase_choices_sql(right: str) -> str:
    every = ", ".join(_phrase_sql(f"'{p}'") for p in phases.PHASES)
    return f"array_to_string(list_concat([{right}], list_filter([{every}], lambda x: x <> {right})), ' | ')"


_NEXT = "CASE phase " + " ".join(f"WHEN '{p}' THEN '{phases.PHASES[(i + 1) % 5]}'" for i, p in enumerate(phases.PHASES)) + " END"
AIMED = f", aimed AS (SELECT *, coalesce({NOUN}, 'object') AS target FROM full_)"
ASKED = {
    "is_stable_grasp": f"SELECT episode_id, step, 'Is the robot''s grasp of the ' || coalesce({NOUN}, 'object') || ' stable?' AS question, {_yes('phase = $$contact$$', 'Cannot be determined | Partially stable')} AS choices FROM full_ WHERE phase IN ('contact', 'immobilization', 'detach')",
    "vqa_task_success_state": f"SELECT episode_id, step, 'The robot is to ' || lower(instruction) || '. Has the robot successfully completed the task?' AS question, {_yes('step >= last_start AND contains(lower(path), $$success$$)', 'Cannot be determined | Task was not attempted')} AS choices FROM full_",
    "vqa_robot_gripper_open": f"SELECT episode_id, step, 'Is the robot''s gripper open?' AS question, {_yes('g <= 0.8', 'Cannot be determined | Partially open')} AS choices FROM full_",
    "vqa_object_reachable": f"SELECT episode_id, step, 'Is there any obstacle blocking the robot from reaching ' || {NOUN} || '?' AS question, 'No | Yes | Cannot be determined | Partially reachable' AS choices FROM full_ WHERE {NOUN} IS NOT NULL",
    "vqa_goal_configuration": "SELECT episode_id, step, 'The robot''s task is to ' || lower(instruction) || '. Which configuration shows the goal state that the robot should achieve?' AS question, 'Configuration A | Configuration B | Configuration C | Configuration D | Configuration E' AS choices FROM full_ WHERE step = last AND EXISTS (SELECT 1 FROM keys k WHERE k.episode_id = full_.episode_id AND k.step <> full_.last)",
    "vqa_action_understanding": f"SELECT episode_id, step, 'The robot is tasked to ' || instruction || '. The robot is interacting with the ' || target || '. Which phase of the grasp action is shown in the image?' AS question, {_phase_choices_sql(_phrase_sql('phase'))} AS choices FROM aimed",
    "vqa_next_action": f"SELECT episode_id, step, 'The robot is tasked to ' || instruction || '. After ' || {_phrase_sql('phase')} || ', what will be the robot''s NEXT action phase?' AS question, {_phase_choices_sql(_phrase_sql(_NEXT))} AS choices FROM aimed",
}
#: The catalogue templates by rank, from 1.
CATALOGUE = ("is_stable_grasp", "vqa_task_success_state", "vqa_robot_gripper_open", "vqa_object_reachable", "vqa_goal_configuration", "vqa_action_understanding", "vqa_next_action")


def _asked(tag: str, rank: int) -> str:
    return f"SELECT episode_id, step, {rank} AS rank, '{tag}' AS tag, question, string_split(choices, ' | ') AS choices FROM ({ASKED[tag]})"


def _finished(source: str, compat: bool = False) -> str:
    """SQL for ``items.finalize`` of a relation (episode_id, step, rank, tag, question, choices)."""
    at = "correct" if compat else _h("nota-at", "item") + " % 5"
    return f"""good AS (SELECT *, episode_id || ':' || step || ':' || tag AS item FROM {source} WHERE len(choices) = 5 OR len(choices) = 4 AND list_sort([trim(choices[1]), trim(choices[2])]) = ['No', 'Yes']),
 sorted_ AS (SELECT *, list_sort(list_transform(range(len(choices)), lambda i: {{'k': md5(concat_ws('|', 'choices', item, i::VARCHAR)), 'i': i, 'c': choices[i + 1]}})) AS s FROM good),
 mixed_ AS (SELECT episode_id, step, rank, tag, question, item, list_transform(s, lambda x: x.c) AS cs, (list_position(list_transform(s, lambda x: x.i), 0) - 1)::INT AS correct FROM sorted_),
 used_ AS (SELECT *, len(cs) = 5 AND {_h('nota', 'item')} / 4294967296.0::DOUBLE < 0.2 AS u, {at} AS place FROM mixed_)
 SELECT episode_id, step, rank, tag, question, array_to_string(CASE WHEN u THEN list_transform(range(5), lambda i: CASE WHEN i = place THEN 'None of the above' ELSE cs[i + 1] END) ELSE cs END, ' | ') AS choices, correct AS correct_answer, chr(65 + correct) AS correct_letter FROM used_"""


@query(KEYED + " " + ASKED["vqa_robot_gripper_open"])
def vqa_gripper_open(spark, d):
    return _shown(items.gripper_open(_keys(spark, d)))


@query(KEYED + " " + ASKED["vqa_object_reachable"])
def vqa_object_reachable(spark, d):
    return _shown(items.object_reachable(_keys(spark, d)))


@query(KEYED + " " + ASKED["vqa_task_success_state"])
def vqa_task_success(spark, d):
    return _shown(items.task_success(_keys(spark, d)))


@query(KEYED + " " + ASKED["is_stable_grasp"])
def vqa_stable_grasp(spark, d):
    return _shown(items.stable_grasp(_keys(spark, d)))


@query(KEYED + AIMED + " " + ASKED["vqa_action_understanding"])
def vqa_action_phase(spark, d):
    return _shown(items.action_phase(_keys(spark, d)))


@query(KEYED + AIMED + " " + ASKED["vqa_next_action"])
def vqa_next_action(spark, d):
    return _shown(items.next_action(_keys(spark, d)))


@query(KEYED + """, g AS (SELECT k.episode_id, l.last, list(k.step ORDER BY md5(concat_ws('|', 'goal', k.episode_id::VARCHAR, k.step::VARCHAR))) AS fs FROM keys k
 JOIN (SELECT episode_id, max(e) AS last FROM runs GROUP BY 1) l ON l.episode_id = k.episode_id WHERE k.step <> l.last GROUP BY ALL)
 SELECT g.episode_id, 'The robot''s task is to ' || lower(instruction) || '. Which configuration shows the goal state that the robot should achieve?' AS question,
 array_to_string(list_concat([last], list_transform(range(4), lambda i: fs[(i % len(fs)) + 1])), ',') AS frames FROM g JOIN about a ON a.episode_id = g.episode_id""")
def vqa_goal_configuration(spark, d):
    keys = _keys(spark, d)
    found = items.goal_configuration(keys).select("episode_id", "question")
    picked = keys.where("step = last").select("episode_id", F.array_join(items.goal_frames(F.col("frames"), F.col("last"), F.col("episode_id")).cast("array<string>"), ",").alias("frames"))
    return found.join(picked, "episode_id")


@query(KEYED + """ SELECT f.episode_id, f.step, 'The robot''s task is to ' || lower(instruction) || '. Which configuration shows the goal state that the robot should achieve?' AS question,
 'Configuration A | Configuration B | Configuration C | Configuration D | Configuration E' AS choices FROM full_ f WHERE EXISTS (SELECT 1 FROM keys k WHERE k.episode_id = f.episode_id AND k.step <> f.last)""")
def vqa_goal_configuration_compat(spark, d):
    return _shown(items.goal_configuration(_keys(spark, d), compat=True))


#: Answer first, then the first four others of a list of candidates in which the answer may be.
_FOUR = """ cs AS (SELECT episode_id, step, question, right_, unnest(cand) AS x, generate_subscripts(cand, 1) AS pos FROM {source}),
 us AS (SELECT episode_id, step, question, right_, x, min(pos) AS pos FROM cs WHERE x <> right_ GROUP BY ALL),
 rs AS (SELECT *, row_number() OVER (PARTITION BY episode_id, step ORDER BY pos) AS n FROM us)
 SELECT episode_id, step, question, list_concat([any_value(right_)], list(x ORDER BY n)) AS choices FROM rs WHERE n <= 4 GROUP BY episode_id, step, question"""


@query(KEYED + """, shown AS (SELECT episode_id, min(step) AS step, any_value(instruction) AS instruction, list(phase ORDER BY step) AS ps, count(*)::INT AS n FROM full_ GROUP BY episode_id),
 told AS (SELECT *, list_transform(ps, lambda p: upper(p[1:1]) || lower(p[2:])) AS ts, list_filter(range(1, n + 1), lambda i: ps[i] <> ps[1]) AS o, list_filter(range(1, n + 1), lambda i: ps[i] = ps[1]) AS m FROM shown WHERE n >= 3),
 pool AS (SELECT episode_id, step, 'For the task ' || chr(39) || instruction || chr(39) || ', what is the correct sequence of action phases shown in the images from left to right?' AS question, array_to_string(ts, ' → ') AS right_,
  list_concat(list_transform(range(16), lambda q: array_to_string(list_transform(list_sort(list_transform(range(n), lambda i: {'k': md5(concat_ws('|', 'order', episode_id::VARCHAR, q::VARCHAR, i::VARCHAR)), 'p': ts[i + 1]})), lambda x: x.p), ' → ')),
   list_transform(o[1:4], lambda j: array_to_string(list_transform(range(1, n + 1), lambda k: ts[CASE WHEN k = 1 THEN j WHEN k = j THEN 1 ELSE k END]), ' → ')),
   CASE WHEN len(o) > 0 THEN list_transform(m[1:5], lambda j: array_to_string(list_transform(range(1, n + 1), lambda k: ts[CASE WHEN k = o[1] THEN j WHEN k = j THEN o[1] ELSE k END]), ' → ')) ELSE [] END,
   list_transform(range(1, 4), lambda k: array_to_string(list_concat(ts[k + 1:], ts[:k]), ' → '))) AS cand FROM told),""" + _FOUR.format(source="pool").replace("list_concat([any_value(right_)], list(x ORDER BY n)) AS choices", "array_to_string(list_concat([any_value(right_)], list(x ORDER BY n)), ' | ') AS choices"))
def vqa_temporal_sequence(spark, d):
    """All keyframes of an episode, three or more; distractors are other orders by hash."""
    shown = _keys(spark, d).groupBy("episode_id").agg(F.min("step").alias("step"), F.first("instruction").alias("instruction"), F.array_sort(F.collect_list(F.struct("step", "phase"))).alias("p"))
    return _shown(items.temporal_sequence(shown.withColumn("phases", F.transform("p", lambda x: x["phase"]))))


def _strings(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


#: Candidates of the trajectory template for relation ``spoken`` (episode_id, step, instruction).
LANGUAGE = f"""drawn AS (SELECT episode_id, step, instruction, i, {_strings(items.INSTRUCTIONS)}[{_h('template', 'episode_id', 'i')} % {len(items.INSTRUCTIONS)} + 1] AS t,
  {_strings(items.OBJECTS)}[{_h('object', 'episode_id', 'i')} % {len(items.OBJECTS)} + 1] AS o, {_strings(items.LOCATIONS)}[{_h('place', 'episode_id', 'i')} % {len(items.LOCATIONS)} + 1] AS l FROM spoken, range(16) r(i) WHERE instruction <> ''),
 made AS (SELECT episode_id, step, instruction, list(CASE WHEN len(string_split(t, '{{}}')) = 3 THEN string_split(t, '{{}}')[1] || o || string_split(t, '{{}}')[2] || l || string_split(t, '{{}}')[3] ELSE string_split(t, '{{}}')[1] || o || string_split(t, '{{}}')[2] END ORDER BY i) AS c FROM drawn GROUP BY ALL),
 pool AS (SELECT episode_id, step, 'Which language instruction best describes the robot''s trajectory shown in the image?' AS question, instruction AS right_, list_concat(c, {_strings(items.instruction_pool()[:5])}) AS cand FROM made),"""


@query("WITH " + ABOUT + ", spoken AS (SELECT episode_id, 0 AS step, instruction FROM about), " + LANGUAGE + _FOUR.format(source="pool").replace("list_concat([any_value(right_)], list(x ORDER BY n)) AS choices", "array_to_string(list_concat([any_value(right_)], list(x ORDER BY n)), ' | ') AS choices"))
def vqa_trajectory_language(spark, d):
    return _shown(items.trajectory_language(about(spark, d).withColumn("step", F.lit(0))))


@query(KEYED + AIMED + ", every_ AS (" + " UNION ALL ".join(_asked(tag, i + 1) for i, tag in enumerate(CATALOGUE)) + "), " + _finished("every_"))
def vqa_all_items(spark, d):
    """Every template of the catalogue generator, finished; the rank keeps the order of templates."""
    done = generation.catalogue_items(_keys(spark, d))
    return done.withColumn("choices", F.array_join("choices", " | "))


@query(KEYED + AIMED + ", every_ AS (" + " UNION ALL ".join(_asked(tag, i + 1) for i, tag in enumerate(CATALOGUE)).replace("WHERE step = last AND EXISTS", "WHERE EXISTS") + "), " + _finished("every_", compat=True))
def vqa_all_items_compat(spark, d):
    done = generation.catalogue_items(_keys(spark, d), compat=True)
    return done.withColumn("choices", F.array_join("choices", " | "))


# Items of raw episodes: an episode is ten vectors; entry 64 is the gripper, 1-3 the position; two cameras a few units before it and one at the wrist.


def _raw_keys(spark, d, whole: bool = False) -> DataFrame:
    """Keyframes of raw episodes.  whole: every episode has its document as instruction, else only one that is an episode of ``events``, too."""
    v = vectors(spark, d)
    s = v.select("episode_id", "step", vec.item(F.col("v"), 63).alias("gripper"), F.slice("v", 1, 6).alias("pose"))
    e = v.select("episode_id").distinct()
    told = _texts(spark, d) if whole else about(spark, d).select("episode_id", "instruction")
    e = e.join(told, "episode_id", "left").select("episode_id", F.coalesce("instruction", F.lit("move the arm")).alias("instruction"), _path(F.col("episode_id")).alias("path"))
    place = lambda at: F.transform(F.slice("v", at, 6), lambda x, i: x / 10 - F.when(i == 2, 3.0).otherwise(0.0))
    none = F.lit(None).cast("array<struct<depth:double,x:int,y:int>>")
    camera = lambda name, at, five: F.struct(F.lit(name).alias("camera"), place(at).alias("extrinsics"), _k().alias("intrinsics"), F.lit(1280).alias("width"), F.lit(720).alias("height"), five.alias("five"))
    seen = v.where("step = 0").join(_five(spark, d), "episode_id", "left").select("episode_id", F.array(camera("ext1", 7, F.col("five")), camera("ext2", 13, none), camera("wrist", 19, none)).alias("cameras"))
    return generation.keyed_steps(s, e, also=("pose",)).join(seen, "episode_id")


def _raw_sql(selected: str) -> str:
    """SQL with relations full_ (keyframes), seen_ (pixels u, v now and un, vn next by camera) and five_."""
    steps_ = "steps AS (SELECT episode_id, step, v[64] AS gripper FROM vectors)"
    keyed = KEYED.replace(STEPS, VECTORS + ", " + steps_).replace(ABOUT, ABOUT_RAW)
    place = lambda at: "[" + ", ".join(f"z[{at + i}] / 10 - {3.0 if i == 2 else 0.0}" for i in range(6)) + "]"
    return keyed + f""", posed AS (SELECT f.*, v.v AS pose, n.v AS nxt, z.v AS z FROM full_ f JOIN vectors v ON v.episode_id = f.episode_id AND v.step = f.step LEFT JOIN vectors n ON n.episode_id = f.episode_id AND n.step = f.step + 1 JOIN vectors z ON z.episode_id = f.episode_id AND z.step = 0),
 views AS (SELECT episode_id, step, last, instruction, pose, nxt, 'ext1' AS camera, {place(7)} AS cam FROM posed UNION ALL SELECT episode_id, step, last, instruction, pose, nxt, 'ext2', {place(13)} FROM posed),
 now_ AS (SELECT episode_id, step, last, instruction, camera, cam, nxt, {_pixel('pose[1:3]', 'cam')} FROM views), now2 AS (SELECT episode_id, step, last, instruction, camera, cam, nxt, {_UV} FROM now_),
 then_ AS (SELECT episode_id, step, last, instruction, camera, u, v, nxt IS NOT NULL AS has_next, {_pixel('nxt[1:3]', 'cam')} FROM now2), seen_ AS (SELECT episode_id, step, last, instruction, camera, u AS u0, v AS v0, has_next, {_UV} FROM then_),
 """ + selected


ABOUT_RAW = ABOUT.replace("'pick up the block'", "'move the arm'").replace("FROM (SELECT DISTINCT user_id AS episode_id FROM events) e LEFT JOIN documents d ON d.doc_id = e.episode_id", "FROM (SELECT DISTINCT episode_id FROM vectors) e LEFT JOIN (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT user_id FROM events)) d ON d.doc_id = e.episode_id")
ABOUT_WHOLE = ABOUT_RAW.replace("(SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT user_id FROM events))", "documents")
COLOURS_SQL = _strings(items.COLOURS)
_COLOUR_CHOICES = f"list_concat([c], list_filter({COLOURS_SQL}, lambda x: x <> c)) AS choices"
RAW = {
    "relative_depth": f"""depth_ AS (SELECT episode_id, step, question, {_COLOUR_CHOICES} FROM (SELECT k.episode_id, k.step, 'In the image from ext1, which colored point is ' || CASE WHEN ask THEN 'CLOSEST' ELSE 'FARTHEST' END || ' to the camera?' AS question,
  {COLOURS_SQL}[list_position(ds, CASE WHEN ask THEN list_min(ds) ELSE list_max(ds) END)] AS c FROM (SELECT *, {_h('ask', 'episode_id', 'step', "'ext1'")} % 2 = 0 AS ask FROM full_) k JOIN five_ f ON f.episode_id = k.episode_id))""",
    "action_direction": f"""turn_ AS (SELECT episode_id, step, question, {_COLOUR_CHOICES} FROM (SELECT episode_id, step, 'The robot task is to ' || instruction || '. Which colored arrow correctly shows the direction the robot will move next?' AS question,
  {COLOURS_SQL}[{_h('colour', 'episode_id', 'step', 'camera')} % 5 + 1] AS c FROM seen_ WHERE has_next AND u0 >= 0 AND v0 >= 0 AND u >= 0 AND v >= 0))""",
    "correspondence": """pair_ AS (SELECT a.episode_id, a.step, a.camera AS ca, b.camera AS cb FROM seen_ a JOIN seen_ b ON a.episode_id = b.episode_id AND a.step = b.step AND a.camera <> b.camera
   WHERE md5(concat_ws('|', 'pair', a.episode_id || ':' || a.step, a.camera)) < md5(concat_ws('|', 'pair', b.episode_id || ':' || b.step, b.camera)) AND a.step + 5 < a.last
   AND a.u0 BETWEEN 0 AND 1279 AND a.v0 BETWEEN 0 AND 719 AND b.u0 BETWEEN 0 AND 1279 AND b.v0 BETWEEN 0 AND 719),
  same_ AS (SELECT episode_id, step, 'In the left image (' || ca || ' camera), a red dot is marked. Which point is the closest point in the right image (' || cb || ' camera) corresponding to the same 3D location?' AS question,
   list_concat([c], list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: x <> c)) AS choices FROM (SELECT *, ['A', 'B', 'C', 'D', 'E'][list_position(list_transform(list_sort(list_transform(range(5),
    lambda i: {'k': md5(concat_ws('|', 'points', episode_id || ':' || step || ':' || ca || ':' || cb, i::VARCHAR)), 'i': i})), lambda x: x.i), 0)] AS c FROM pair_))""",
}


def _of_tag(found: DataFrame, tag: str) -> DataFrame:
    return found.where(F.col("tag") == tag).select("episode_id", "step", "question", F.array_join("choices", " | ").alias("choices"))


def _each_camera(spark, d, whole: bool = False) -> DataFrame:
    """Keyframes by camera but the wrist's, with its columns."""
    return _raw_keys(spark, d, whole).withColumn("x", F.explode("cameras")).where("x.camera <> 'wrist'").select("*", "x.camera", "x.five", "x.extrinsics", "x.intrinsics")


@query(_raw_sql(RAW["action_direction"]).replace(ABOUT_RAW, ABOUT_WHOLE) + " SELECT episode_id, step, question, array_to_string(choices, ' | ') AS choices FROM turn_")
def vqa_action_direction(spark, d):
    """Every raw episode is told its own document, whether or not ``events`` has an episode of its number."""
    k = _each_camera(spark, d, whole=True).where("next_pose is not null")
    k = k.withColumns({"p": geo.pixel_of(F.col("pose"), F.col("extrinsics"), F.col("intrinsics")), "q": geo.pixel_of(F.col("next_pose"), F.col("extrinsics"), F.col("intrinsics"))})
    return _shown(items.action_direction(k.where("p.u >= 0 and p.v >= 0 and q.u >= 0 and q.v >= 0")))


@query(_raw_sql(RAW["correspondence"]) + " SELECT episode_id, step, question, array_to_string(choices, ' | ') AS choices FROM same_")
def vqa_correspondence(spark, d):
    """Two cameras drawn for each keyframe; a point that both see."""
    keys = _raw_keys(spark, d).withColumn("pair", items.camera_pair(F.filter("cameras", lambda x: x["camera"] != "wrist"), F.concat_ws(":", F.col("episode_id").cast("string"), F.col("step").cast("string"))))
    keys = keys.select("*", F.col("pair.a.camera").alias("camera1"), F.col("pair.b.camera").alias("camera2"))
    w, h = F.lit(1280), F.lit(720)
    keys = keys.withColumns({f"in{k}": geo.pixel_of(F.col("pose"), F.col(f"pair.{k}.extrinsics"), F.col(f"pair.{k}.intrinsics")) for k in "ab"})
    both = keys.where(geo.in_image(F.col("ina"), w, h) & geo.in_image(F.col("inb"), w, h) & (F.col("step") + 5 < F.col("last"))).withColumn("right", F.col("inb"))
    name = F.concat_ws(":", F.col("episode_id").cast("string"), F.col("step").cast("string"), "camera1", "camera2")
    return _shown(items.correspondence(both.withColumn("wrong", items.quadrant_points(name, F.col("right"), w, h))))


@query("WITH " + VECTORS + f""", t AS (SELECT episode_id, step, v[1:6] AS p, first_value(v[1:6]) OVER (PARTITION BY episode_id ORDER BY step) AS z FROM vectors),
 u AS (SELECT episode_id, step, [p[1] - z[1], p[2] - z[2], p[3] - z[3], p[4] - z[4], p[5] - z[5], p[6] - z[6]] AS d FROM t), w AS (SELECT *, [abs(d[1]), abs(d[2]), abs(d[3])] AS a FROM u), x AS (SELECT episode_id, step, {{right}} AS right_ FROM w),
 y AS (SELECT *, list_sort(list_transform(list_filter({_strings(items.DIRECTIONS)}, lambda q: q <> right_), lambda q: {{{{'far': q[1:5] <> right_[1:5], 'k': md5(concat_ws('|', 'direction', episode_id::VARCHAR, step::VARCHAR, q)), 'q': q}}}})) AS s FROM x)
 SELECT episode_id, step, 'In the image from ext1 at step ' || step || ', which direction is the block relative to the robot''s end effector?' AS question, array_to_string(list_concat([right_], list_transform(s[1:4], lambda x: x.q)), ' | ') AS choices FROM y""".format(right=_direction("a", "list_max(a)")))
def vqa_relative_direction(spark, d):
    """Every step asks for the direction to the pose at the first."""
    first = F.first("v").over(phases.episode("step"))
    k = vectors(spark, d).withColumns({"contact_pose": F.slice(first, 1, 6), "pose": F.slice("v", 1, 6), "phase": F.lit("pre_grasp"), "camera": F.lit("ext1"), "instruction": F.lit("move the block")})
    return _shown(items.relative_direction(k))


_DEPTH = _raw_sql("").replace("WITH RECURSIVE ", "WITH RECURSIVE " + VECTORS + ", " + FIVE + ", ", 1).replace(VECTORS + ", " + FIVE + ", " + VECTORS + ", ", VECTORS + ", " + FIVE + ", ")


@query(_DEPTH + RAW["relative_depth"] + " SELECT episode_id, step, question, array_to_string(choices, ' | ') AS choices FROM depth_")
def vqa_relative_depth(spark, d):
    return _shown(items.relative_depth(_each_camera(spark, d)))


@query(_DEPTH + ", ".join(RAW.values()) + ", spoken AS (SELECT episode_id, step, instruction FROM full_ WHERE step = 0), " + LANGUAGE.rstrip(",") + ", lang_ AS (WITH " + _FOUR.format(source="pool").lstrip() + "), every_ AS (" + " UNION ALL ".join([
    "SELECT episode_id, step, 0 AS rank, 'vqa_trajectory_understanding' AS tag, question, choices FROM lang_, range(2)",
    _asked("vqa_task_success_state", 2), _asked("vqa_goal_configuration", 5),
    "SELECT episode_id, step, 10, 'vqa_relative_depth', question, choices FROM depth_",
    "SELECT episode_id, step, 11, 'vqa_action_direction_selection', question, choices FROM turn_",
    "SELECT episode_id, step, 12, 'vqa_multi_view_correspondence', question, choices FROM same_",
]) + "), " + _finished("every_"))
def vqa_raw_items(spark, d):
    """Every template of the generator for raw episodes, finished."""
    done = generation.raw_items(_raw_keys(spark, d))
    return done.withColumn("choices", F.array_join("choices", " | "))


def _part_items(spark, d) -> DataFrame:
    """Question, choices (own brand first, then four others by hash) of every part."""
    brands = [f"Brand#{i}" for i in range(1, 26)]
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("question"), "p_brand", "p_size")
    others = F.array_remove(F.array(*[F.lit(b) for b in brands]), F.col("p_brand"))
    ranked = F.array_sort(F.transform(others, lambda b: F.struct(digest("brand", F.col("item"), b).alias("k"), b.alias("b"))))
    return p.select("item", "question", "p_size", F.concat(F.array("p_brand"), F.transform(F.slice(ranked, 1, 4), lambda x: x["b"])).alias("choices"))


PARTS = """items AS (SELECT p_partkey AS item, p_name AS question, p_size, list_concat([p_brand], list_transform(list_slice(list_sort(list_transform(
 list_filter(list_transform(range(1, 26), lambda i: 'Brand#' || i), lambda b: b <> p_brand), lambda b: {'k': md5(concat_ws('|', 'brand', p_partkey::VARCHAR, b)), 'b': b})), 1, 4), lambda x: x.b)) AS choices FROM part)"""
SHUFFLED = PARTS + """, keyed AS (SELECT item, question, choices, list_sort(list_transform(range(5), lambda i: {'k': md5(concat_ws('|', 'choices', item::VARCHAR, i::VARCHAR)), 'i': i, 'c': choices[i + 1]})) AS s FROM items),
 mixed AS (SELECT item, question, list_transform(s, lambda x: x.c) AS choices, list_position(list_transform(s, lambda x: x.i), 0) - 1 AS correct FROM keyed)"""


@query("WITH " + SHUFFLED + " SELECT item, array_to_string(choices, ' | ') AS choices, correct::BIGINT AS correct FROM mixed")
def vqa_shuffle_choices(spark, d):
    return _part_items(spark, d).withColumn("s", items.shuffled(F.col("choices"), F.col("item"))).select("item", F.array_join("s.choices", " | ").alias("choices"), F.col("s.correct").cast("long").alias("correct"))


@query("WITH " + SHUFFLED + f", used AS (SELECT *, {_h('nota', 'item')} / 4294967296.0::DOUBLE < 0.2 AS u FROM mixed) SELECT item, CASE WHEN u THEN array_to_string(list_transform(range(5), lambda i: CASE WHEN i = correct THEN 'None of the above' ELSE choices[i + 1] END), ' | ') ELSE array_to_string(choices, ' | ') END AS choices, correct::BIGINT AS correct FROM used")
def vqa_nota(spark, d):
    s = _part_items(spark, d).withColumn("s", items.shuffled(F.col("choices"), F.col("item")))
    n = s.withColumn("n", items.none_of_above(F.col("s.choices"), F.col("s.correct"), F.col("item"), compat=True))
    return n.select("item", F.array_join("n.choices", " | ").alias("choices"), F.col("n.correct").cast("long").alias("correct"))


@query("WITH " + SHUFFLED + f", used AS (SELECT *, {_h('nota', 'item')} / 4294967296.0::DOUBLE < 0.2 AS u, {_h('nota-at', 'item')} % 5 AS place FROM mixed) SELECT item, CASE WHEN u THEN array_to_string(list_transform(range(5), lambda i: CASE WHEN i = place THEN 'None of the above' ELSE choices[i + 1] END), ' | ') ELSE array_to_string(choices, ' | ') END AS choices, correct::BIGINT AS correct FROM used")
def vqa_nota_default(spark, d):
    s = _part_items(spark, d).withColumn("s", items.shuffled(F.col("choices"), F.col("item")))
    n = s.withColumn("n", items.none_of_above(F.col("s.choices"), F.col("s.correct"), F.col("item")))
    return n.select("item", F.array_join("n.choices", " | ").alias("choices"), F.col("n.correct").cast("long").alias("correct"))


@query("WITH " + PARTS + ", cut AS (SELECT item, choices[1:(p_size % 6)] AS c, p_size % 7 - 1 AS correct FROM items) SELECT item, len(c)::BIGINT AS n, coalesce((len(c) = 5) AND correct >= 0 AND correct < len(c), false) AS valid FROM cut")
def vqa_validate(spark, d):
    p = _part_items(spark, d).withColumn("c", F.slice("choices", 1, F.col("p_size") % 6))
    return p.select("item", F.size("c").cast("long").alias("n"), items.is_valid(F.col("c"), F.col("p_size") % 7 - 1).alias("valid"))


@query("WITH " + SHUFFLED + " SELECT item, question, array_to_string(choices, ' | ') AS choices, correct::BIGINT AS correct FROM mixed")
def vqa_json_roundtrip(spark, d):
    s = _part_items(spark, d).withColumn("s", items.shuffled(F.col("choices"), F.col("item")))
    js = s.select("item", items.to_json(F.col("question"), F.col("s.choices"), F.col("s.correct"), F.array(F.sha2(F.col("question").cast("binary"), 256))).alias("j"))
    back = js.select("item", F.from_json("j", items.ITEM).alias("x"))
    return back.select("item", F.col("x.question.text").alias("question"), F.array_join("x.choices.text", " | ").alias("choices"), items.correct_index(F.col("x.choices")).cast("long").alias("correct"))


@query("SELECT conv_id, turn, 'conv_' || conv_id || '_q' || (turn + 1) AS id, text FROM conversations")
def vqa_flatten_ids(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", txt.unique_id(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")), F.col("turn")).alias("id"), "text")


# Text.


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '^\.+|\.+$', '', 'g'), '^,+|,+$', '', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents")
def clean_instruction(spark, d):
    return table(spark, d, "documents").select("doc_id", txt.clean_instruction(F.col("text")).alias("clean"))


@query(r"SELECT doc_id, 'droid_' || regexp_replace(regexp_replace(text, '[^\p{L}\p{N} _]', '_', 'g'), '\s+$', '') || '_' || (doc_id + 1) AS name FROM documents")
def sanitize_instruction(spark, d):
    return table(spark, d, "documents").select("doc_id", txt.output_name(F.lit("droid"), F.col("text"), F.col("doc_id")).alias("name"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '/trajectory.h5' ELSE split_part(url, '?', 1) END AS path FROM pages)
 SELECT page_id, coalesce(nullif(regexp_extract(path, '([^/]+)/trajectory\\.h5$', 1), ''), nullif(string_split(path, '/')[-2], ''), 'unknown') AS episode FROM p""")
def path_episode_id(spark, d):
    path = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/trajectory.h5"))).otherwise(F.split_part("url", F.lit("?"), F.lit(1)))
    return table(spark, d, "pages").select("page_id", txt.episode_id_of_path(path).alias("episode"))


@query("WITH " + ABOUT + " SELECT episode_id, CASE WHEN episode_id % 2 = 0 THEN 'success' ELSE 'failure' END || '/ep' || episode_id AS folder, episode_id % 2 = 0 AS success FROM about")
def path_raw_folder(spark, d):
    p = about(spark, d)
    return p.select("episode_id", txt.raw_folder(F.col("path")).alias("folder"), txt.path_success(F.col("path")).alias("success"))


@query("SELECT doc_id, CASE WHEN contains(text, 'office') THEN 'office' WHEN contains(lower(text), 'kitchen') THEN 'kitchen' WHEN contains(lower(text), 'lab') THEN 'lab' ELSE 'unknown' END AS scene FROM (SELECT doc_id, lower(text) AS text FROM documents)")
def instruction_nlp_fallback(spark, d):
    return table(spark, d, "documents").select("doc_id", txt.scene_fallback(F.col("text")).alias("scene"))


@query("WITH " + PARTS + " SELECT item, question || array_to_string(list_transform(choices[1:5], lambda c, i: ' ' || chr((64 + i)::INT) || '. ' || c), '') AS prompt FROM items")
def format_mcq_benchmark(spark, d):
    return _part_items(spark, d).select("item", txt.mcq_benchmark(F.col("question"), F.col("choices")).alias("prompt"))


@query("WITH " + PARTS + " SELECT item, question || chr(10) || 'Choices:' || chr(10) || array_to_string(list_transform(choices, lambda c, i: chr((64 + i)::INT) || '. ' || c || chr(10)), '') AS prompt FROM items")
def format_mcq_finetune(spark, d):
    return _part_items(spark, d).select("item", txt.mcq_finetune(F.col("question"), F.col("choices")).alias("prompt"))


@query("WITH " + PARTS + ", t AS (SELECT item, choices, chr((65 + p_size % 7)::INT) AS letter FROM items) SELECT item, letter || '. ' || choices[CASE WHEN letter BETWEEN 'A' AND 'E' THEN ascii(letter) - 64 ELSE 1 END] AS answer FROM t")
def conversation_format(spark, d):
    p = _part_items(spark, d).withColumn("m", txt.conversation(F.col("question"), F.col("choices"), F.chr(F.lit(65) + F.col("p_size") % 7)))
    return p.select("item", F.expr("m[1].content[0].text").alias("answer"))


@query(r"SELECT conv_id, turn, nullif(upper(regexp_extract(text, '(?i)[A-E]', 0)), '') AS letter FROM conversations WHERE role = 'assistant'")
def extract_letter_first(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", txt.letter_first(F.col("text")).alias("letter"))


_ASCII_ONLY = r"regexp_replace(text, '[^\x00-\x7F]', '_', 'g')"


@query(rf"""WITH a AS (SELECT conv_id, turn, {_ASCII_ONLY} AS text FROM conversations WHERE role = 'assistant'),
 c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\n+|\n+$', '', 'g'), '\.+$', ''), '/+$', ''), '^ +| +$', '', 'g'), '^:+', '') AS x FROM a),
 f AS (SELECT conv_id, turn, regexp_extract_all(upper(x), '\b([A-E])\b', 1) AS found, regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^\.+|\.+$', '', 'g') AS rest FROM c)
 SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(found[-1], rest), '\.+$', ''), '/+$', '') AS letter FROM f""")
def extract_letter_last(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "_"))
    return c.select("conv_id", "turn", txt.letter_last(F.col("text")).alias("letter"))


# Data set building.


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= CASE source WHEN 'droid' THEN 7000 ELSE 30 END")
def dataset_episode_cap(spark, d):
    """A tenth of each dataset's cap, which the sources of these tables exceed."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return catalogue.cap_episodes(docs, F.floor(catalogue.cap_of(F.col("source")) / 10), "source", ["doc_id"])


_CLASSES = ["/data/DROID/x", *[f"/data/{part}/x" for part, _ in txt.SOURCE_CLASSES], "/data/droid_and_taco_play/x"]


@query("SELECT doc_id, CASE WHEN contains(lower(p), 'droid') THEN 'droid' " + " ".join(f"WHEN contains(p, '{part}') THEN '{name}'" for part, name in txt.SOURCE_CLASSES) + f" ELSE 'other' END AS kind FROM (SELECT doc_id, coalesce({_strings(_CLASSES)}[doc_id % {len(_CLASSES) + 1} + 1], '/data/' || source) AS p FROM documents)")
def source_classify(spark, d):
    path = F.coalesce(F.get(F.array(*[F.lit(x) for x in _CLASSES]), F.col("doc_id") % (len(_CLASSES) + 1)), F.concat(F.lit("/data/"), "source"))
    return table(spark, d, "documents").select("doc_id", txt.classify_source(path).alias("kind"))


@query(f"SELECT doc_id, CASE WHEN {_h('split', 'doc_id')} / 4294967296.0::DOUBLE < 1000000.0::DOUBLE / 1010000.0::DOUBLE THEN 'train' ELSE 'test' END AS split FROM documents")
def train_test_split(spark, d):
    share = splits.threshold(F.lit(1_000_000.0), F.lit(10_000.0))
    return table(spark, d, "documents").select("doc_id", splits.split_label(F.col("doc_id"), share).alias("split"))


@query(f"SELECT doc_id, source FROM documents ORDER BY {_h('cap', 'doc_id')}, doc_id LIMIT 500")
def size_cap(spark, d):
    return splits.size_cap(table(spark, d, "documents").select("doc_id", "source"), 500, "doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS c FROM documents) WHERE n > c - c * 20 // 100")
def fallback_tail_20pct(spark, d):
    return splits.tail_share(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 20, 16)


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_h('3407', 'doc_id')}, doc_id) <= ceil(count(*) OVER () * 500 / 10000) THEN 'val' ELSE 'train' END AS split FROM documents")
def train_val_split(spark, d):
    return splits.validation_split(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("""WITH c AS (SELECT c_nationkey AS n, c_custkey AS k, c_acctbal AS m FROM customer) SELECT s.s_suppkey, n.n_name, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN c.m END, CASE WHEN s_suppkey % 2 = 0 THEN -c.m END, CASE WHEN s_suppkey % 3 = 0 THEN c.m + 1 END, s.s_acctbal) AS value
 FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN c ON c.n = s.s_nationkey AND c.k = s.s_suppkey""")
def extrinsics_priority(spark, d):
    """Three sources: one has every fourth serial, one every second, one every third; a camera's own values come last."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("episode_id"), F.col("s_suppkey").alias("serial"), F.array("s_acctbal").alias("extrinsics"))
    c = table(spark, d, "customer")
    of = lambda name, every, value: c.where(F.col("c_custkey") % every == 0).select(F.lit(name).alias("source"), F.col("c_nationkey").alias("episode_id"), F.col("c_custkey").alias("serial"), F.array(value).alias("extrinsics"))
    lookup = of("cam2cam", 3, F.col("c_acctbal") + 1).unionByName(of("superset", 4, F.col("c_acctbal"))).unionByName(of("cam2base", 2, -F.col("c_acctbal")))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("episode_id"), "n_name")
    return episodes.prioritized(s, lookup).join(n, "episode_id", "left").select(F.col("serial").alias("s_suppkey"), "n_name", F.col("extrinsics")[0].alias("value"))


@query("SELECT p.p_partkey AS item, sha256(g.html) AS image FROM part p LEFT JOIN pages g ON g.page_id = p.p_partkey")
def image_left_join(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"))
    return p.join(table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("image")), "page_id", "left").withColumnRenamed("page_id", "item")


@query("""WITH s AS (SELECT p_partkey AS item, 100 + (p_partkey * 37) % 3000 AS w, 100 + (p_partkey * 53) % 2500 AS h FROM part)
 SELECT item, CASE WHEN greatest(w, h) <= 1280 THEN w WHEN w > h THEN 1280 ELSE trunc(w * (1280.0::DOUBLE / h))::BIGINT END AS width, CASE WHEN greatest(w, h) <= 1280 THEN h WHEN w > h THEN trunc(h * (1280.0::DOUBLE / w))::BIGINT ELSE 1280 END AS height FROM s""")
def image_resize_dims(spark, d):
    k = F.col("p_partkey")
    r = geo.resized(F.lit(100) + k * 37 % 3000, F.lit(100) + k * 53 % 2500)
    return table(spark, d, "part").select(k.alias("item"), r.alias("r")).select("item", F.col("r.width").cast("long").alias("width"), F.col("r.height").cast("long").alias("height"))


@query("SELECT sha256(text) AS image_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def image_dedup_sha256(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("image_id"))
    return docs.groupBy("image_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM documents) * 100 AS percent FROM documents GROUP BY source")
def scene_task_share(spark, d):
    return evaluation.shares(table(spark, d, "documents"), "source")


# Scoring: a response for every order line; its model by supplier, its question by part.


def _responses(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    found = F.chr(F.lit(65) + draw("answer", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")) % 3 * 13)
    expected = F.col("l_returnflag")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("question_id"), F.concat(F.lit("model"), (F.col("l_suppkey") % 4).cast("string")).alias("model"), expected.alias("expected"),
        found.alias("predicted_letter"), txt.is_correct(found, expected).alias("correct"), F.col("l_linestatus").alias("tag"), F.col("l_quantity").alias("response_time"),
    )


RESPONSES = f"""responses AS (SELECT l_orderkey || '-' || l_linenumber AS question_id, 'model' || (l_suppkey % 4) AS model, l_returnflag AS expected,
 chr((65 + {_h('answer', 'l_orderkey', 'l_linenumber', 'l_suppkey')} % 3 * 13)::INT) AS predicted_letter, l_linestatus AS tag, l_quantity AS response_time FROM lineitem),
 scored AS (SELECT *, coalesce(predicted_letter = upper(expected), false) AS correct FROM responses)"""


@query("WITH " + RESPONSES + " SELECT count(*) AS total, sum(correct::INT)::BIGINT AS hits, sum(correct::INT)::DOUBLE / count(*) * 100 AS accuracy FROM scored")
def accuracy_overall(spark, d):
    return evaluation.accuracy(_responses(spark, d))


@query("WITH " + RESPONSES + " SELECT tag, count(*) AS total, sum(correct::INT)::BIGINT AS hits, sum(correct::INT)::DOUBLE / count(*) * 100 AS accuracy, round(avg(response_time), 6) AS mean_time FROM scored GROUP BY tag")
def accuracy_by_tag(spark, d):
    return evaluation.accuracy_by_tag(_responses(spark, d)).withColumn("mean_time", F.round("mean_time", 6))


@query("WITH " + RESPONSES + " SELECT model, count(*) AS total, sum(correct::INT)::BIGINT AS hits, round(avg(response_time), 6) AS mean_time, sum(correct::INT)::DOUBLE / count(*) * 100 AS accuracy FROM scored GROUP BY model")
def model_summary(spark, d):
    return evaluation.model_summary(_responses(spark, d)).withColumn("mean_time", F.round("mean_time", 6))


@query("WITH " + RESPONSES + " SELECT tag, " + ", ".join(f"round(coalesce(avg(correct::INT) FILTER (WHERE model = 'model{i}'), 0) * 100, 6) AS model{i}" for i in range(4)) + " FROM scored GROUP BY tag")
def tag_model_pivot(spark, d):
    models = [f"model{i}" for i in range(4)]
    return evaluation.tag_model_pivot(_responses(spark, d), models).withColumns({m: F.round(m, 6) for m in models})


def _paired(spark, d) -> DataFrame:
    """Every question answered by three models, one of which may give nothing."""
    li = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("question_id"), "l_returnflag", F.explode(F.array(*[F.lit(f"m{i}") for i in range(3)])).alias("model"))
    n = draw("pair", F.col("question_id"), F.col("model")) % 4
    got = F.when(n < 3, F.chr(F.lit(65) + n * 13))
    return li.select("question_id", "model", got.alias("predicted_letter"), txt.is_correct(got, F.col("l_returnflag")).alias("correct"))


PAIRED = f"""base AS (SELECT l_orderkey || '-' || l_linenumber AS question_id, l_returnflag, unnest(['m0', 'm1', 'm2']) AS model FROM lineitem), drawn AS (SELECT *, {_h('pair', 'question_id', 'model')} % 4 AS n FROM base),
 r AS (SELECT question_id, model, CASE WHEN n < 3 THEN chr((65 + n * 13)::INT) END AS p, coalesce(CASE WHEN n < 3 THEN chr((65 + n * 13)::INT) END = l_returnflag, false) AS c FROM drawn)"""


@query("WITH " + PAIRED + """, x AS (SELECT a.model AS model_a, b.model AS model_b, a.p IS DISTINCT FROM b.p AS differ, a.c AS ca, b.c AS cb FROM r a JOIN r b ON a.question_id = b.question_id AND a.model < b.model)
 SELECT model_a, model_b, count(*) AS total, count_if(differ)::BIGINT AS disagreements, count_if(differ AND ca AND NOT cb)::BIGINT AS a_better, count_if(differ AND cb AND NOT ca)::BIGINT AS b_better,
 count_if(differ AND NOT ca AND NOT cb)::BIGINT AS both_wrong, count_if(differ)::DOUBLE / count(*) * 100 AS percent FROM x GROUP BY ALL""")
def model_disagreement(spark, d):
    return evaluation.disagreement(_paired(spark, d))


@query("SELECT 'm' || (o_custkey % 3) AS model, o_orderkey::VARCHAR AS question_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def result_cache_misses(spark, d):
    cases = table(spark, d, "orders").select(F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model"), F.col("o_orderkey").cast("string").alias("question_id"))
    held = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("question_id")).distinct()
    cache = cases.join(held, "question_id")
    return evaluation.cache_misses(cases, cache)


@query("SELECT n_name AS dataset, count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS succeeded, count_if(o_orderstatus <> 'F')::BIGINT AS failed, count_if(o_orderstatus = 'F')::DOUBLE / count(*) * 100 AS rate FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name)")
def dataset_success_summary(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "n_name")
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("success")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    return evaluation.success_summary(o.select(F.col("n_name").alias("dataset"), "success"))


_PERCENT = "round(sum(hits)::DOUBLE / sum(total) * 100, 6)::DOUBLE::VARCHAR"


@query("WITH " + RESPONSES + f""", t AS (SELECT model, tag, count(*) AS total, sum(correct::INT)::BIGINT AS hits FROM scored GROUP BY ALL), e AS (SELECT model, tag, '"' || tag || '":{{"total":' || total || ',"hits":' || hits || ',"accuracy":' || round(hits::DOUBLE / total * 100, 6)::DOUBLE || '}}' AS x, total, hits FROM t)
 SELECT model, '{{"model":"' || model || '","total":' || sum(total)::BIGINT || ',"hits":' || sum(hits)::BIGINT || ',"accuracy":' || {_PERCENT} || ',"tags":{{' || string_agg(x, ',' ORDER BY tag) || '}}}}' AS result FROM e GROUP BY model""")
def results_json(spark, d):
    return evaluation.results_json(_responses(spark, d))


QUERIES |= helper_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL |= helper_queries.ORACLE_SQL | source_queries.ORACLE_SQL
