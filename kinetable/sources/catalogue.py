"""Dataset dimension tables: cameras and encodings, episode caps, catalogue paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_instruction

# Encodings.
PROPRIO = {"NONE": -1, "POS_EULER": 1, "POS_QUAT": 2, "JOINT": 3, "JOINT_BIMANUAL": 4, "POS_NAV": 5}
ACTION = {"EEF_POS": 1, "JOINT_POS": 2, "JOINT_POS_BIMANUAL": 3, "NAV_2D": 4, "JOINT_POS_BIMANUAL_NAV": 5}

# Dataset; primary, secondary and wrist camera; their depth cameras; proprio; action.
DATASETS = (
    ("fractal20220817_data", ("image", None, None), (None, None, None), "POS_QUAT", "EEF_POS"),
    ("kuka", ("image", None, None), (None, None, None), "POS_QUAT", "EEF_POS"),
    ("bridge_dataset", ("image_0", "image_1", None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("taco_play", ("rgb_static", None, "rgb_gripper"), ("depth_static", None, "depth_gripper"), "POS_EULER", "EEF_POS"),
    ("jaco_play", ("image", None, "image_wrist"), (None, None, None), "POS_EULER", "EEF_POS"),
    ("berkeley_cable_routing", ("image", "top_image", "wrist45_image"), (None, None, None), "JOINT", "EEF_POS"),
    ("roboturk", ("front_rgb", None, None), (None, None, None), "NONE", "EEF_POS"),
    ("nyu_door_opening_surprising_effectiveness", (None, None, "image"), (None, None, None), "NONE", "EEF_POS"),
    ("viola", ("agentview_rgb", None, "eye_in_hand_rgb"), (None, None, None), "JOINT", "EEF_POS"),
    ("berkeley_autolab_ur5", ("image", None, "hand_image"), ("depth", None, None), "POS_QUAT", "EEF_POS"),
    ("toto", ("image", None, None), (None, None, None), "JOINT", "EEF_POS"),
    ("language_table", ("rgb", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("columbia_cairlab_pusht_real", ("image", None, "wrist_image"), (None, None, None), "POS_EULER", "EEF_POS"),
    ("stanford_kuka_multimodal_dataset_converted_externally_to_rlds", ("image", None, None), ("depth_image", None, None), "POS_QUAT", "EEF_POS"),
    ("nyu_rot_dataset_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("stanford_hydra_dataset_converted_externally_to_rlds", ("image", None, "wrist_image"), (None, None, None), "POS_EULER", "EEF_POS"),
    ("austin_buds_dataset_converted_externally_to_rlds", ("image", None, "wrist_image"), (None, None, None), "JOINT", "EEF_POS"),
    ("nyu_franka_play_dataset_converted_externally_to_rlds", ("image", "image_additional_view", None), ("depth", "depth_additional_view", None), "POS_EULER", "EEF_POS"),
    ("maniskill_dataset_converted_externally_to_rlds", ("image", None, "wrist_image"), ("depth", None, "wrist_depth"), "POS_QUAT", "EEF_POS"),
    ("furniture_bench_dataset_converted_externally_to_rlds", ("image", None, "wrist_image"), (None, None, None), "POS_QUAT", "EEF_POS"),
    ("cmu_franka_exploration_dataset_converted_externally_to_rlds", ("highres_image", None, None), (None, None, None), "NONE", "EEF_POS"),
    ("ucsd_kitchen_dataset_converted_externally_to_rlds", ("image", None, None), (None, None, None), "JOINT", "EEF_POS"),
    ("ucsd_pick_and_place_dataset_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("austin_sailor_dataset_converted_externally_to_rlds", ("image", None, "wrist_image"), (None, None, None), "POS_QUAT", "EEF_POS"),
    ("austin_sirius_dataset_converted_externally_to_rlds", ("image", None, "wrist_image"), (None, None, None), "POS_QUAT", "EEF_POS"),
    ("bc_z", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("utokyo_pr2_opening_fridge_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("utokyo_pr2_tabletop_manipulation_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("utokyo_xarm_pick_and_place_converted_externally_to_rlds", ("image", "image2", "hand_image"), (None, None, None), "POS_EULER", "EEF_POS"),
    ("utokyo_xarm_bimanual_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("robo_net", ("image", "image1", None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("berkeley_mvp_converted_externally_to_rlds", (None, None, "hand_image"), (None, None, None), "POS_QUAT", "JOINT_POS"),
    ("berkeley_rpt_converted_externally_to_rlds", (None, None, "hand_image"), (None, None, None), "JOINT", "JOINT_POS"),
    ("kaist_nonprehensile_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_QUAT", "EEF_POS"),
    ("stanford_mask_vit_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("tokyo_u_lsmo_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("dlr_sara_pour_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("dlr_sara_grid_clamp_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("dlr_edan_shared_control_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("asu_table_top_converted_externally_to_rlds", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("stanford_robocook_converted_externally_to_rlds", ("image_1", "image_2", None), ("depth_1", "depth_2", None), "POS_EULER", "EEF_POS"),
    ("imperialcollege_sawyer_wrist_cam", ("image", None, "wrist_image"), (None, None, None), "NONE", "EEF_POS"),
    ("iamlab_cmu_pickup_insert_converted_externally_to_rlds", ("image", None, "wrist_image"), (None, None, None), "JOINT", "EEF_POS"),
    ("uiuc_d3field", ("image_1", "image_2", None), ("depth_1", "depth_2", None), "NONE", "EEF_POS"),
    ("utaustin_mutex", ("image", None, "wrist_image"), (None, None, None), "JOINT", "EEF_POS"),
    ("berkeley_fanuc_manipulation", ("image", None, "wrist_image"), (None, None, None), "JOINT", "EEF_POS"),
    ("cmu_playing_with_food", ("image", None, "finger_vision_1"), (None, None, None), "POS_EULER", "EEF_POS"),
    ("cmu_play_fusion", ("image", None, None), (None, None, None), "JOINT", "EEF_POS"),
    ("cmu_stretch", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
    ("gnm_dataset", ("image", None, None), (None, None, None), "POS_NAV", "NAV_2D"),
    ("aloha_static_dataset", ("cam_high", "cam_low", "cam_right_wrist"), (None, None, None), "JOINT_BIMANUAL", "JOINT_POS_BIMANUAL"),
    ("aloha_dagger_dataset", ("cam_high", "cam_low", "cam_right_wrist"), (None, None, None), "JOINT_BIMANUAL", "JOINT_POS_BIMANUAL"),
    ("aloha_mobile_dataset", ("cam_high", None, "cam_right_wrist"), (None, None, None), "JOINT_BIMANUAL", "JOINT_POS_BIMANUAL_NAV"),
    ("fmb_dataset", ("image_side_1", "image_side_2", "image_wrist_1"), ("image_side_1_depth", "image_side_2_depth", "image_wrist_1_depth"), "POS_EULER", "EEF_POS"),
    ("dobbe", (None, None, "wrist_image"), (None, None, None), "POS_EULER", "EEF_POS"),
    ("roboset", ("image_left", "image_right", "image_wrist"), (None, None, None), "JOINT", "JOINT_POS"),
    ("rh20t", ("image_front", "image_side_right", "image_wrist"), (None, None, None), "POS_EULER", "EEF_POS"),
    ("mujoco_manip", ("image", None, None), (None, None, None), "POS_EULER", "EEF_POS"),
)

# Episodes taken of each dataset.
DEFAULT_CAP = 300
CAPS = {"droid": 70000, "berkeley_autolab_ur5": 600, "fractal20220817_data": 6000, "nyu_door_opening_surprising_effectiveness": 200}
DEFAULT_DATASETS = (
    "droid", "berkeley_autolab_ur5", "fractal20220817_data", "taco_play", "viola", "stanford_kuka_multimodal_dataset_converted_externally_to_rlds",
    "austin_buds_dataset_converted_externally_to_rlds", "austin_sirius_dataset_converted_externally_to_rlds", "berkeley_mvp_converted_externally_to_rlds",
    "asu_table_top_converted_externally_to_rlds", "nyu_rot_dataset_converted_externally_to_rlds", "berkeley_fanuc_manipulation",
)


def dataset_config(spark: SparkSession) -> DataFrame:
    """One row a dataset, with its camera keys in the order primary, secondary, wrist."""
    rows = []
    for name, images, depths, proprio, action in DATASETS:
        rows.append((name, *images, *depths, PROPRIO[proprio], ACTION[action]))
    schema = "dataset string, primary string, secondary string, wrist string, depth_primary string, depth_secondary string, depth_wrist string, proprio_encoding int, action_encoding int"
    return spark.createDataFrame(rows, schema).withColumn("cameras", F.array_compact(F.array("primary", "secondary", "wrist")))


def catalogue_name(dataset: Column) -> Column:
    """The registry's name of a dataset."""
    return F.when(dataset == "bridge", "bridge_dataset").otherwise(dataset)


def catalogue_path(dataset: Column, root: str) -> Column:
    version = F.when(dataset == "robo_net", "1.0.0").when(dataset == "language_table", "0.0.1").otherwise("0.1.0")
    return F.concat(F.lit(root + "/"), dataset, F.lit("/"), version)


def cap_of(dataset: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, cap in CAPS.items():
        out = out.when(dataset == name, cap)
    return out.otherwise(DEFAULT_CAP)


def cap_episodes(episodes: DataFrame, cap: Column, dataset: str, order: list[str], salts: tuple[int, ...] = (512, 64, 8, 1)) -> DataFrame:
    """The first ``cap`` episodes of each dataset by ``order``.

    Ranked within ever fewer salted parts: each round leaves ``cap`` rows a part, and eight parts go into one
    of the next, so no task ranks more than eight times the cap after the first, which ranks 1/512 of a dataset.
    """
    out = episodes.withColumn("_cap", cap).withColumn("_salt", F.xxhash64(*order))
    for n in salts:
        part = Window.partitionBy(dataset, F.pmod("_salt", F.lit(n))).orderBy(*order)
        out = out.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= F.col("_cap"))
    return out.drop("_n", "_salt", "_cap")


def catalogue_steps(spark: SparkSession, folder: str, datasets: tuple[str, ...] = DEFAULT_DATASETS, episodes: int | None = None, skip_blank: tuple[str, ...] = ("droid",)) -> DataFrame:
    """Steps of the data sets under ``folder``/<dataset>/, Parquet exports with episode_id, step, language_instruction and the source's own fields.

    An episode's instruction is its first step's, cleaned.  Of a data set in ``skip_blank`` episodes without
    one are left out; others keep them.  No more than the data set's cap, or ``episodes`` if that is less, are taken, by
    episode_id; data sets that are not there give nothing.
    """
    out = None
    for name in datasets:
        try:
            rows = spark.read.parquet(f"{folder}/{catalogue_name_of(name)}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        told = rows.groupBy("episode_id").agg(F.min_by("language_instruction", "step").alias("instruction"))
        told = told.withColumn("instruction", clean_instruction(F.coalesce("instruction", F.lit("")))).withColumn("dataset", F.lit(name))
        if name in skip_blank:
            told = told.where("instruction <> ''")
        cap = cap_of(F.col("dataset"))
        kept = cap_episodes(told, F.least(cap, F.lit(episodes)) if episodes is not None else cap, "dataset", ["episode_id"])
        found = rows.drop("language_instruction", "dataset", "instruction").join(kept, "episode_id")
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return spark.createDataFrame([], "episode_id string, step int, instruction string, dataset string") if out is None else out


def catalogue_name_of(name: str) -> str:
    return "bridge_dataset" if name == "bridge" else name


def swapped_channels(dataset: Column) -> Column:
    """Whether a data set's pictures are red-green-blue and have to be turned for writers of blue-green-red: all but raw episodes'."""
    return dataset != "droid"
