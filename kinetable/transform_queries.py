"""The registered query of all per-dataset transforms, and its oracle: a formula in SQL for each.

Ten vectors of ``embeddings`` are an episode; a source's fields are slices of a vector.  Of every dataset
come the sizes of its action and proprio vectors and sums of their entries weighted by position, so an entry
that is wrong, missing or out of place shows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.standardize import REGISTRY, standardize

#: The fields that the transforms read: where in a vector they lie; one number where there is no end.
FIELDS: dict[str, tuple[int, int | None]] = {
    "action": (0, 10), "state": (10, 26), "world_vector": (26, 29), "rotation_delta": (29, 32), "gripper_closedness_action": (32, 33), "end_effector_cartesian_pos": (34, 41),
    "robot_state": (41, 56), "robot_obs": (41, 56), "effector_translation": (56, 58), "end_effector_pose": (34, 41), "tcp_pose": (34, 41), "xyz_residual": (26, 32),
    "axis_angle_residual": (29, 35), "target_close": (33, 36), "xyz": (36, 39), "axis_angle": (39, 42), "sensed_close": (42, 43), "gripper_closed": (44, 45), "gripper_states": (45, 46),
    "state_gripper": (46, 47), "eef_pose": (34, 41), "state_gripper_pose": (46, 47), "tcp_base": (47, 54), "joint_pos": (55, 63), "position": (0, 2),
    "gripper": (43, None), "gripper_width": (54, None), "yaw": (2, None),
}


def fields(vectors: DataFrame) -> DataFrame:
    """episode_id, step and every field of ``vectors(episode_id, step, v)``."""
    one = lambda a, b: F.col("v")[a] if b is None else F.slice("v", a + 1, b - a)
    codes = F.array(*[F.lit(x) for x in (104, 105, 0, 106)])
    return vectors.select("episode_id", "step", *[one(a, b).alias(n) for n, (a, b) in FIELDS.items()], (F.col("v")[33] > 0).alias("open_gripper"), codes.alias("instruction_codes"), F.lit("say").alias("natural_language_instruction"))


def _sum(x: Column) -> Column:
    return F.round(F.aggregate(F.transform(x, lambda y, i: y * (i + 1)), F.lit(0.0), lambda a, y: a + y), 6)


def _facts(name: str, action: Column, proprio: Column | None, gripper: Column | None, instruction: Column) -> list[Column]:
    none = F.lit(None).cast("double")
    return [
        F.lit(name).alias("dataset"), F.size(action).alias("n"), _sum(action).alias("a"), (F.lit(None).cast("int") if proprio is None else F.size(proprio)).alias("m"),
        (none if proprio is None else _sum(proprio)).alias("p"), (none if gripper is None else gripper.cast("double")).alias("g"), instruction.alias("instruction"),
    ]


def standardize_all(vectors: DataFrame) -> DataFrame:
    """dataset, episode_id, step, n, a, m, p, g, instruction of all transforms; those that leave the steps alone share one scan."""
    rows = fields(vectors)
    plain = [n for n, p in REGISTRY.items() if not p.before and not p.after]
    own = []
    for n in plain:
        p = REGISTRY[n]
        said = p.instruction() if p.instruction else F.col("natural_language_instruction")
        own.append(F.struct(*_facts(n, p.action() if p.action else F.col("action"), p.proprio and p.proprio(), p.gripper and p.gripper(), said)))
    out = [rows.select("episode_id", "step", F.explode(F.array(*own)).alias("x")).select("episode_id", F.col("step").cast("int").alias("step"), "x.*")]
    for n in REGISTRY:
        if n not in plain:
            done = standardize(rows, n)
            out.append(done.select("episode_id", F.col("step").cast("int").alias("step"), *_facts(n, F.col("action"), F.col("proprio") if "proprio" in done.columns else None, None, F.col("instruction"))))
    return reduce(DataFrame.unionByName, out)


def _inverted(x: str) -> str:
    return f"[1.0 - {x}]"


def _clipped(x: str) -> str:
    return f"greatest(least({x}, 1.0), 0.0)"


def _cat(*x: str) -> str:
    return "list_concat(" + ", ".join(x) + ")" if len(x) > 1 else x[0]


def _zeros(n: int) -> str:
    return "[" + ", ".join(["0.0"] * n) + "]"


_N = "(action[4] * action[4] + action[5] * action[5] + action[6] * action[6] + action[7] * action[7])"
_EULER = f"""[atan2(2.0 * (action[7] * action[4] + action[5] * action[6]) / {_N}, 1.0 - 2.0 * (action[4] * action[4] + action[5] * action[5]) / {_N}),
 asin(least(greatest(2.0 * (action[7] * action[5] - action[6] * action[4]) / {_N}, -1.0), 1.0)),
 atan2(2.0 * (action[7] * action[6] + action[4] * action[5]) / {_N}, 1.0 - 2.0 * (action[5] * action[5] + action[6] * action[6]) / {_N})]"""
_MOVED = "world_vector, rotation_delta"
_X = "_converted_externally_to_rlds"
_LAST, _CLOSED = "action[10]", "gripper_closedness_action[1]"
#: dataset: action, proprio, gripper position (None: as it is, or none), and whether the instruction is blank.
FORMULAS: dict[str, tuple[str | None, str | None, str | None, bool]] = {
    "berkeley_autolab_ur5": (None, None, "robot_state[14]", False),
    "fractal20220817_data": (None, None, "gripper_closed[1]", False),
    "kuka": (None, None, "gripper_closed[1]", False),
    "taco_play": (None, None, "robot_obs[7]", False),
    "viola": (None, None, "gripper_states[1]", False),
    f"stanford_kuka_multimodal_dataset{_X}": (None, None, "state[16]", False),
    f"austin_buds_dataset{_X}": (None, None, "state[8]", False),
    f"austin_sirius_dataset{_X}": (None, None, "state_gripper[1]", False),
    f"berkeley_mvp{_X}": (None, None, "gripper", False),
    f"asu_table_top{_X}": (None, None, "state[16]", False),
    f"nyu_rot_dataset{_X}": (None, None, "state[16]", False),
    "berkeley_fanuc_manipulation": (None, None, "state[7]", False),
    "jaco_play": (_cat("world_vector", _zeros(3), f"[-{_CLOSED}]"), "end_effector_cartesian_pos", None, False),
    "berkeley_cable_routing": (_cat(_MOVED, _zeros(1)), "robot_state", None, True),
    "roboturk": (_cat(_MOVED, _inverted(_clipped(_CLOSED))), _zeros(1), None, True),
    "nyu_door_opening_surprising_effectiveness": (_cat(_MOVED, f"[-{_CLOSED}]"), _zeros(1), None, False),
    "toto": (_cat(_MOVED, "[open_gripper::INT::DOUBLE]"), "state", None, True),
    "language_table": (_cat("action", _zeros(10), _zeros(10), "[1.0]"), "effector_translation", None, False),
    "columbia_cairlab_pusht_real": (_cat(_MOVED, f"[{_CLOSED}]"), "robot_state", None, False),
    f"stanford_hydra_dataset{_X}": (_cat("action[1:6]", _inverted(_LAST)), _cat("state[1:3]", "state[8:10]", "state[14:14]"), None, True),
    f"nyu_franka_play_dataset{_X}": (_cat("action[3:8]", f"[{_clipped('action[9]')}]"), "state[11:16]", None, True),
    f"maniskill_dataset{_X}": (None, _cat("tcp_pose", "state[8:8]"), None, False),
    f"furniture_bench_dataset{_X}": (_cat("action[1:3]", _EULER, _inverted(_clipped(_LAST))), _cat("state[1:7]", "state[16:16]"), None, False),
    f"cmu_franka_exploration_dataset{_X}": ("action[1:9]", _zeros(1), None, False),
    f"ucsd_kitchen_dataset{_X}": ("action[1:9]", "state[1:7]", None, False),
    f"ucsd_pick_and_place_dataset{_X}": (_cat("action[1:3]", _zeros(3), f"[{_LAST}]"), "state", None, False),
    f"austin_sailor_dataset{_X}": (_cat("action[1:6]", _inverted(_clipped(_LAST))), "state", None, True),
    "bc_z": (_cat("xyz_residual[1:3]", "axis_angle_residual[1:3]", _inverted("target_close[1]")), _cat("xyz", "axis_angle", "sensed_close"), None, False),
    f"utokyo_pr2_opening_fridge{_X}": ("action[1:9]", "state", None, False),
    f"utokyo_pr2_tabletop_manipulation{_X}": ("action[1:9]", "state", None, False),
    f"utokyo_xarm_pick_and_place{_X}": (None, None, None, False),
    f"utokyo_xarm_bimanual{_X}": ("action[4:10]", "end_effector_pose", None, False),
    "robo_net": (_cat("action[1:4]", _zeros(2), f"[{_LAST}]"), _cat("state[1:4]", _zeros(2), "state[16:16]"), None, False),
    f"kaist_nonprehensile{_X}": (_cat("action[1:6]", _zeros(1)), "state[10:16]", None, False),
    f"stanford_mask_vit{_X}": (_cat("action[1:4]", _zeros(2), f"[{_LAST}]"), _cat("end_effector_pose[1:4]", _zeros(2), "end_effector_pose[7:7]"), None, False),
    f"tokyo_u_lsmo{_X}": (None, _cat("state[1:6]", "state[16:16]"), None, False),
    f"dlr_sara_pour{_X}": (None, "state", None, False),
    f"dlr_sara_grid_clamp{_X}": (None, "state[1:6]", None, False),
    f"dlr_edan_shared_control{_X}": (_cat("action[1:6]", _inverted(_LAST)), "state", None, False),
    f"stanford_robocook{_X}": (None, "state", None, False),
    "imperialcollege_sawyer_wrist_cam": ("action[1:9]", _zeros(1), None, False),
    f"iamlab_cmu_pickup_insert{_X}": (_cat("action[1:3]", _EULER, "action[8:8]"), _cat("state[1:7]", "state[8:8]"), None, False),
    "uiuc_d3field": (_cat("action", _zeros(10), _zeros(1)), _zeros(1), None, False),
    "utaustin_mutex": (_cat("action[1:6]", _inverted(_clipped(_LAST))), "state[1:8]", None, True),
    "cmu_playing_with_food": (_cat("action[1:3]", _EULER, f"[{_LAST}]"), "state", None, False),
    "cmu_play_fusion": (_cat("action[1:3]", "action[7:10]"), "state", None, False),
    "cmu_stretch": ("action[1:9]", _cat("state[1:3]", _zeros(3), "state[16:16]"), None, False),
    "fmb_dataset": (None, _cat("eef_pose", "state_gripper_pose"), None, False),
    "dobbe": (None, "state", None, False),
    "roboset": (_cat("action[1:7]", _inverted(_clipped(_LAST))), "state", None, False),
    "rh20t": (_cat("tcp_base", "[gripper]"), _cat("tcp_base", "[gripper_width]"), None, False),
    "mujoco_manip": (_cat("action[1:6]", _inverted(f"({_LAST} / 255.0)")), None, None, False),
}
#: Those that change the sequence: relation, action, proprio.
_W = "(PARTITION BY episode_id ORDER BY step)"
SEQUENCES: dict[str, tuple[str, str, str]] = {
    "bridge_dataset": (
        f"SELECT *, lead(state) OVER {_W} AS ahead, coalesce(first_value(CASE WHEN {_LAST} > 0.95 THEN 1.0 WHEN {_LAST} < 0.05 THEN 0.0 END IGNORE NULLS) OVER f, last_value({_LAST}) OVER f) AS last_ FROM src WINDOW f AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
        "list_concat(list_transform(range(1, 7), lambda i: ahead[i] - state[i]), [last_])", "state",
    ),
    f"berkeley_rpt{_X}": (f"SELECT * EXCLUDE (step), step // 3 AS step, lead(joint_pos) OVER {_W} AS ahead FROM src WHERE step % 3 = 0", f"list_concat(list_transform(range(1, 8), lambda i: ahead[i] - joint_pos[i]), [1.0 - {_LAST}])", "list_concat(joint_pos, [gripper])"),
    "gnm_dataset": (
        f"""SELECT * EXCLUDE (step, ahead_), step // 3 AS step, lead(position) OVER {_W} AS ahead FROM (SELECT *, sqrt(first_value(action[1]) OVER w * first_value(action[1]) OVER w + first_value(action[2]) OVER w * first_value(action[2]) OVER w) AS top,
 nth_value(position, 2) OVER w AS ahead_, nth_value(position[1], 2) OVER w - first_value(position[1]) OVER w AS fx, nth_value(position[2], 2) OVER w - first_value(position[2]) OVER w AS fy FROM src
 WINDOW w AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE step % 3 = 0""",
        "[((ahead[1] - position[1]) * cos(yaw) + (ahead[2] - position[2]) * sin(yaw)) * (top / sqrt(fx * fx + fy * fy)), ((ahead[2] - position[2]) * cos(yaw) - (ahead[1] - position[1]) * sin(yaw)) * (top / sqrt(fx * fx + fy * fy))]",
        "state",
    ),
    **{f"aloha_{k}_dataset": ("SELECT * EXCLUDE (step), step // 5 AS step, true AS ahead FROM src WHERE step % 5 = 0", "action", "state") for k in ("static", "dagger", "mobile")},
}


def _weighted(x: str) -> str:
    return f"round(list_sum(list_transform({x}, lambda y, i: y * i)), 6)"


def oracle_sql(vectors: str) -> str:
    """``vectors``: the CTE of that name (episode_id, step, v)."""
    one = lambda n, a, b: f"v[{a + 1}] AS {n}" if b is None else f"v[{a + 1}:{b}] AS {n}"
    parts = []
    for name, (action, proprio, gripper, blank) in FORMULAS.items():
        said = "''" if blank else "'hi'" if name == "language_table" else "'say'"
        m, p = (f"len({proprio})", _weighted(proprio)) if proprio else ("NULL", "NULL::DOUBLE")
        parts.append(f"SELECT episode_id, step, '{name}' AS dataset, len({action or 'action'}) AS n, {_weighted(action or 'action')} AS a, {m} AS m, {p} AS p, {gripper or 'NULL::DOUBLE'} AS g, {said} AS instruction FROM src")
    for name, (source, action, proprio) in SEQUENCES.items():
        parts.append(f"SELECT episode_id, step, '{name}', len({action}), {_weighted(action)}, len({proprio}), {_weighted(proprio)}, NULL::DOUBLE, 'say' FROM ({source}) WHERE ahead IS NOT NULL")
    return f"WITH {vectors}, src AS (SELECT episode_id, step, {', '.join(one(n, a, b) for n, (a, b) in FIELDS.items())}, v[34] > 0 AS open_gripper FROM vectors) " + " UNION ALL ".join(parts)
