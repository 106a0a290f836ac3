"""Standardisation of per-dataset action and state vectors, as column plans.

A plan names columns for action, proprio and instruction and, where the sequence itself changes, a
function over the steps.  ``standardize`` applies the plan of one dataset to its steps; steps carry the
source's fields as columns: action (vector or, for structured sources, its parts under their own
names) and the observation's vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clip, euler_of_quaternion, invert, item, subtract, take, zeros
from .phases import episode
from .sequences import binarize, gnm_waypoints, relabel_actions, subsample

Make = Callable[[], Column]


@dataclass(frozen=True)
class Plan:
    action: Make | None = None
    proprio: Make | None = None
    instruction: Make | None = None
    gripper: Make | None = None
    before: Callable[[DataFrame], DataFrame] | None = None
    after: Callable[[DataFrame], DataFrame] | None = None


c = F.col
A = lambda a=0, b=None: take(c("action"), a, b)
S = lambda a=0, b=None: take(c("state"), a, b)
one = lambda x: F.array(x)
no_state = lambda: zeros(1)
blank = lambda: F.lit("")
natural = lambda: c("natural_language_instruction")
state = lambda: c("state")
inverted = lambda x: one(invert(x))
inverted_clip = lambda x: one(invert(clip(x)))
six = lambda last: (lambda: F.concat(A(0, 6), last()))
but_last = lambda: A(0, -1)
moved = lambda: (c("world_vector"), c("rotation_delta"))


def _bridge(steps: DataFrame) -> DataFrame:
    last = binarize(steps.withColumn("_g", item(c("action"), -1)), "_g")
    return relabel_actions(last.withColumn("action", F.concat(A(0, 6), one(c("open")))).drop("_g", "open"))


def _rpt(steps: DataFrame) -> DataFrame:
    thin = subsample(steps, 3)
    ahead = F.lead("joint_pos").over(episode("step"))
    out = thin.withColumn("proprio", F.concat("joint_pos", one(c("gripper").cast("double")))).withColumn("_ahead", ahead).where("_ahead is not null")
    return out.withColumn("action", F.concat(subtract(take(c("_ahead"), 0, 7), take(c("joint_pos"), 0, 7)), F.transform(A(-1), lambda x: F.lit(1.0) - x))).drop("_ahead")


def _gnm(steps: DataFrame) -> DataFrame:
    flat = steps.select("episode_id", "step", item(c("position"), 0).alias("x"), item(c("position"), 1).alias("y"), c("yaw"), item(c("action"), 0).alias("ax"), item(c("action"), 1).alias("ay"))
    return gnm_waypoints(flat).withColumn("action", F.array("wx", "wy")).drop("wx", "wy").join(subsample(steps, 3).drop("action"), ["episode_id", "step"])


def _first_text() -> Column:
    """Code points as text, up to the first zero."""
    return F.split_part(F.array_join(F.transform(c("instruction_codes"), lambda x: F.when(x > 0, F.chr(x)).otherwise(F.lit("\x00"))), ""), F.lit("\x00"), F.lit(1))


# One reading a step: where the gripper position comes from.
PER_STEP = {
    "berkeley_autolab_ur5": Plan(gripper=lambda: item(c("robot_state"), 13)),
    "fractal20220817_data": Plan(gripper=lambda: item(c("gripper_closed"), 0)),
    "kuka": Plan(gripper=lambda: item(c("gripper_closed"), 0)),
    "taco_play": Plan(gripper=lambda: item(c("robot_obs"), 6)),
    "viola": Plan(gripper=lambda: item(c("gripper_states"), 0)),
    "stanford_kuka_multimodal_dataset_converted_externally_to_rlds": Plan(gripper=lambda: item(c("state"), -1)),
    "austin_buds_dataset_converted_externally_to_rlds": Plan(gripper=lambda: item(c("state"), 7)),
    "austin_sirius_dataset_converted_externally_to_rlds": Plan(gripper=lambda: item(c("state_gripper"), 0)),
    "berkeley_mvp_converted_externally_to_rlds": Plan(gripper=lambda: c("gripper").cast("double")),
    "asu_table_top_converted_externally_to_rlds": Plan(gripper=lambda: item(c("state"), -1)),
    "nyu_rot_dataset_converted_externally_to_rlds": Plan(gripper=lambda: item(c("state"), -1)),
    "berkeley_fanuc_manipulation": Plan(gripper=lambda: item(c("state"), 6)),
}

_aloha = Plan(proprio=state, before=lambda d: subsample(d, 5))
# Whole episodes: action, proprio and instruction.
BATCHED = {
    "bridge_dataset": Plan(proprio=state, after=_bridge),
    "jaco_play": Plan(lambda: F.concat(c("world_vector"), zeros(3), one(-item(c("gripper_closedness_action"), 0))), lambda: c("end_effector_cartesian_pos"), natural),
    "berkeley_cable_routing": Plan(lambda: F.concat(*moved(), zeros(1)), lambda: c("robot_state"), blank),
    "roboturk": Plan(lambda: F.concat(*moved(), inverted_clip(item(c("gripper_closedness_action"), 0))), no_state, blank),
    "nyu_door_opening_surprising_effectiveness": Plan(lambda: F.concat(*moved(), one(-item(c("gripper_closedness_action"), 0))), no_state),
    "toto": Plan(lambda: F.concat(*moved(), one(c("open_gripper").cast("double"))), state, blank),
    "language_table": Plan(lambda: F.concat(c("action"), F.transform(c("action"), lambda x: F.lit(0.0)), F.transform(c("action"), lambda x: F.lit(0.0)), F.array(F.lit(1.0))), lambda: c("effector_translation"), _first_text),
    "columbia_cairlab_pusht_real": Plan(lambda: F.concat(*moved(), one(item(c("gripper_closedness_action"), 0))), lambda: c("robot_state"), natural),
    "stanford_hydra_dataset_converted_externally_to_rlds": Plan(six(lambda: inverted(item(c("action"), -1))), lambda: F.concat(S(0, 3), S(7, 10), S(-3, -2)), blank),
    "nyu_franka_play_dataset_converted_externally_to_rlds": Plan(lambda: F.concat(A(-8, -2), one(clip(item(c("action"), -2)))), lambda: S(-6), blank),
    "maniskill_dataset_converted_externally_to_rlds": Plan(None, lambda: F.concat(c("tcp_pose"), S(7, 8))),
    "furniture_bench_dataset_converted_externally_to_rlds": Plan(lambda: F.concat(A(0, 3), euler_of_quaternion(A(3, 7)), inverted_clip(item(c("action"), -1))), lambda: F.concat(S(0, 7), S(-1))),
    "cmu_franka_exploration_dataset_converted_externally_to_rlds": Plan(but_last, no_state),
    "ucsd_kitchen_dataset_converted_externally_to_rlds": Plan(but_last, lambda: S(0, 7)),
    "ucsd_pick_and_place_dataset_converted_externally_to_rlds": Plan(lambda: F.concat(A(0, 3), zeros(3), A(-1)), state),
    "austin_sailor_dataset_converted_externally_to_rlds": Plan(six(lambda: inverted_clip(item(c("action"), -1))), state, blank),
    "bc_z": Plan(
        lambda: F.concat(take(c("xyz_residual"), 0, 3), take(c("axis_angle_residual"), 0, 3), inverted(item(c("target_close"), 0))), lambda: F.concat("xyz", "axis_angle", "sensed_close"), natural
    ),
    "utokyo_pr2_opening_fridge_converted_externally_to_rlds": Plan(but_last, state),
    "utokyo_pr2_tabletop_manipulation_converted_externally_to_rlds": Plan(but_last, state),
    "utokyo_xarm_pick_and_place_converted_externally_to_rlds": Plan(),
    "utokyo_xarm_bimanual_converted_externally_to_rlds": Plan(lambda: A(-7), lambda: c("end_effector_pose")),
    "robo_net": Plan(lambda: F.concat(A(0, 4), zeros(2), A(-1)), lambda: F.concat(S(0, 4), zeros(2), S(-1))),
    "berkeley_rpt_converted_externally_to_rlds": Plan(after=_rpt),
    "kaist_nonprehensile_converted_externally_to_rlds": Plan(six(lambda: zeros(1)), lambda: S(-7)),
    "stanford_mask_vit_converted_externally_to_rlds": Plan(lambda: F.concat(A(0, 4), zeros(2), A(-1)), lambda: F.concat(take(c("end_effector_pose"), 0, 4), zeros(2), take(c("end_effector_pose"), -1))),
    "tokyo_u_lsmo_converted_externally_to_rlds": Plan(None, lambda: F.concat(S(0, 6), S(-1))),
    "dlr_sara_pour_converted_externally_to_rlds": Plan(None, state),
    "dlr_sara_grid_clamp_converted_externally_to_rlds": Plan(None, lambda: S(0, 6)),
    "dlr_edan_shared_control_converted_externally_to_rlds": Plan(six(lambda: inverted(item(c("action"), -1))), state),
    "stanford_robocook_converted_externally_to_rlds": Plan(None, state),
    "imperialcollege_sawyer_wrist_cam": Plan(but_last, no_state),
    "iamlab_cmu_pickup_insert_converted_externally_to_rlds": Plan(lambda: F.concat(A(0, 3), euler_of_quaternion(A(3, 7)), A(7, 8)), lambda: F.concat(S(0, 7), S(7, 8))),
    "uiuc_d3field": Plan(lambda: F.concat(c("action"), F.transform(c("action"), lambda x: F.lit(0.0)), zeros(1)), no_state),
    "utaustin_mutex": Plan(six(lambda: inverted_clip(item(c("action"), -1))), lambda: S(0, 8), blank),
    "cmu_playing_with_food": Plan(lambda: F.concat(A(0, 3), euler_of_quaternion(A(3, 7)), A(-1)), state),
    "cmu_play_fusion": Plan(lambda: F.concat(A(0, 3), A(-4)), state),
    "cmu_stretch": Plan(but_last, lambda: F.concat(S(0, 3), zeros(3), S(-1))),
    "gnm_dataset": Plan(proprio=state, after=_gnm),
    "aloha_static_dataset": _aloha,
    "aloha_dagger_dataset": _aloha,
    "aloha_mobile_dataset": _aloha,
    "fmb_dataset": Plan(None, lambda: F.concat("eef_pose", "state_gripper_pose")),
    "dobbe": Plan(None, state),
    "roboset": Plan(lambda: F.concat(A(0, 7), inverted_clip(item(c("action"), -1))), state),
    "rh20t": Plan(lambda: F.concat(c("tcp_base"), one(c("gripper").cast("double"))), lambda: F.concat(c("tcp_base"), one(c("gripper_width")))),
    "mujoco_manip": Plan(six(lambda: inverted(item(c("action"), -1) / F.lit(255.0)))),
}
REGISTRY = PER_STEP | BATCHED


def uniform_instruction(columns: list[str]) -> Column | None:
    """The natural-language instruction, else the plain one."""
    have = [c(x) for x in ("natural_language_instruction", "language_instruction") if x in columns]
    return F.coalesce(*have) if have else None


def standardize(steps: DataFrame, dataset: str) -> DataFrame:
    """The dataset's steps with action, proprio, gripper_position and instruction in the common form; a dataset without a plan raises KeyError.

    Where an embedding of the instruction is carried, the source's own instruction field is emptied once it is copied.
    """
    plan = REGISTRY["bridge_dataset" if dataset == "bridge" else dataset]
    out = plan.before(steps) if plan.before else steps
    text = plan.instruction() if plan.instruction else uniform_instruction(out.columns)
    new = {name: make() for name, make in (("action", plan.action), ("proprio", plan.proprio), ("gripper_position", plan.gripper)) if make}
    out = out.withColumns(new | ({"instruction": text} if text is not None else {}))
    if "natural_language_embedding" in out.columns and "natural_language_instruction" in out.columns:
        out = out.withColumn("natural_language_instruction", F.lit(None).cast("string"))
    return plan.after(out) if plan.after else out


def standardize_all(sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every dataset that has a plan, standardised; the others are left out."""
    return {name: standardize(steps, name) for name, steps in sources.items() if ("bridge_dataset" if name == "bridge" else name) in REGISTRY}
