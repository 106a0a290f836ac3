"""Multiple-choice items: validation, choice order, none-of-the-above, JSON, and the question templates.

A template is a column: a struct (rank, tag, question, choices) whose first choice is right, null where
it does not apply.  ``made`` turns any number of them into rows (episode_id, step, rank, tag, question,
choices) in one pass over the keyframes.  ``finalize`` orders the choices by hash, so the same item always
comes out the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.geometry import direction_label
from ..functions.hashing import digest, draw, draw01
from ..functions.text import first_noun
from ..functions.vectors import subtract
from .phases import PHASES, following_phase

NONE = "None of the above"
#: The column of the noun that an instruction is about; ``with_noun`` adds it.
NOUN = "_noun"
# Answers, phrases and fallback lists of the templates.
OPEN_THRESHOLD = 0.8
DIRECTIONS = [v if not h else f"{v} {h}" for v in ("Upper", "Lower") for h in ("", "Left", "Right", "Forward", "Backward")]
OBJECTS = ("cup", "box", "ball", "book", "pen", "toy", "block", "plate", "bottle", "container")
LOCATIONS = ("table", "shelf", "drawer", "bin", "tray", "surface", "floor", "corner", "center", "platform")
INSTRUCTIONS = (
    "Pick up the {} from the {}", "Move the {} to the {}", "Place the {} on the {}", "Push the {} towards the {}", "Rotate the {} clockwise",
    "Slide the {} to the right", "Grab the {} with the gripper", "Lift the {} upward", "Drop the {} into the {}", "Align the {} with the {}",
)
PHASE_PHRASES = {
    "pre_grasp": ("Approaching the ", " with open gripper"),
    "immobilization": ("Closing gripper to grasp the ", ""),
    "contact": ("Firmly grasping the ", ""),
    "detach": ("Releasing the ", " by opening gripper"),
    "post_grasp": ("Moving away with open gripper after releasing the ", ""),
}


def is_valid(choices: Column, correct: Column) -> Column:
    """Four choices that begin with Yes and No, or five of any kind; the right one among them."""
    n = F.size(choices)
    trimmed = F.transform(F.slice(choices, 1, 2), lambda c: F.trim(c))
    binary = (n == 4) & (F.array_sort(trimmed) == F.array(F.lit("No"), F.lit("Yes")))
    return F.coalesce((binary | (n == 5)) & (correct >= 0) & (correct < n), F.lit(False))


def shuffled(choices: Column, item: Column, seed: str = "choices") -> Column:
    """(choices, correct) in hash order; the first choice given is the right one."""
    keyed = F.array_sort(F.transform(choices, lambda c, i: F.struct(digest(seed, item, i).alias("k"), i.alias("i"), c.alias("c"))))
    return F.struct(F.transform(keyed, lambda x: x["c"]).alias("choices"), (F.array_position(F.transform(keyed, lambda x: x["i"]), F.lit(0)) - 1).cast("int").alias("correct"))


def none_of_above(choices: Column, correct: Column, item: Column, share: float = 0.2, compat: bool = False, seed: str = "nota") -> Column:
    """(choices, correct) with the last resort in a fifth of the five-choice items.

    compat: it always takes the right choice's place and is right.  Otherwise it takes a drawn place;
    it is right only where that was the right choice's.
    """
    use = (F.size(choices) == 5) & (draw01(seed, item) < share)
    at = correct if compat else F.pmod(draw(seed + "-at", item), F.lit(5)).cast("int")
    return F.struct(F.when(use, F.transform(choices, lambda c, i: F.when(i == at, F.lit(NONE)).otherwise(c))).otherwise(choices).alias("choices"), correct.alias("correct"))


def finalize(items: DataFrame, compat: bool = False, figures: Observation | None = None) -> DataFrame:
    """Items with shuffled choices, the right one's index and letter; malformed ones are dropped.

    ``figures`` is told, by the action that takes the result, how many items were seen, taken and ``rejected``, and how many
    of these had no choices at all; it costs no scan of its own.
    """
    if figures is not None:
        items = observed(items, figures)
    key = F.concat_ws(":", F.col("episode_id").cast("string"), F.col("step").cast("string"), F.col("tag"))
    good = items.where(is_valid(F.col("choices"), F.lit(0))).withColumn("item", key)
    mixed = good.withColumn("s", shuffled(F.col("choices"), F.col("item")))
    done = mixed.withColumn("n", none_of_above(F.col("s.choices"), F.col("s.correct"), F.col("item"), compat=compat))
    return done.select("episode_id", "step", "rank", "tag", "question", F.col("n.choices").alias("choices"), F.col("n.correct").alias("correct_answer"), F.chr(F.col("n.correct") + 65).alias("correct_letter"))


def observed(items: DataFrame, figures: Observation) -> DataFrame:
    good = is_valid(F.col("choices"), F.lit(0))
    return items.observe(figures, F.count("*").alias("seen"), F.count_if(good).alias("taken"), F.count_if(~good).alias("rejected"), F.count_if(F.coalesce(F.size("choices"), F.lit(0)) <= 0).alias("without_choices"))


def rejected(items: DataFrame) -> DataFrame:
    """The quarantine: items that are not well formed."""
    return items.where(~is_valid(F.col("choices"), F.lit(0)))


def to_json(question: Column, choices: Column, correct: Column, images: Column) -> Column:
    """One item as {question: {text, image_ids}, choices: [{text, image_id, is_correct}]}."""
    return F.to_json(
        F.struct(
            F.struct(question.alias("text"), images.alias("image_ids")).alias("question"),
            F.transform(choices, lambda c, i: F.struct(c.alias("text"), F.lit(None).cast("string").alias("image_id"), (i == correct).alias("is_correct"))).alias("choices"),
        )
    )


ITEM = "question struct<text:string,image_ids:array<string>>,choices array<struct<text:string,image_id:string,is_correct:boolean>>,metadata map<string,string>"


def correct_index(choices: Column) -> Column:
    """The first choice marked right, null if none is."""
    flags = F.transform(choices, lambda c: F.coalesce(c["is_correct"], F.lit(False)))
    return F.nullif(F.array_position(flags, F.lit(True)), F.lit(0)) - 1


def _binary(truth: Column, *others: str) -> Column:
    yes = F.when(truth, F.lit("Yes")).otherwise(F.lit("No"))
    no = F.when(truth, F.lit("No")).otherwise(F.lit("Yes"))
    return F.array(yes, no, *[F.lit(x) for x in others])


def _item(rank: int, tag: str, question: Column, choices: Column, when: Column | None = None) -> Column:
    """One item; null unless ``when`` holds."""
    item = F.struct(F.lit(rank).alias("rank"), F.lit(tag).alias("tag"), question.alias("question"), choices.alias("choices"))
    return item if when is None else F.when(when, item)


def with_noun(rows: DataFrame) -> DataFrame:
    """``rows(instruction)`` with the noun that templates ask about; of episodes, so a text is searched once and not for every keyframe.

    As an array's only row it is made here; a projection's column may be made anew for each match of a join after it.
    """
    found = F.explode(F.array(F.struct(first_noun(F.col("instruction")).alias(NOUN))))
    return rows.withColumn("_found", found).withColumn(NOUN, F.col("_found")[NOUN]).drop("_found")


def made(keys: DataFrame, *templates: Column, several: Column | None = None) -> DataFrame:
    """The items of all ``templates``, and of ``several``, an array of such, for every row of ``keys``.

    The noun that templates ask about is found once a row where ``keys`` don't bring it (``with_noun``).  Items are made in one projection, in generated code, and
    exploded by a slice of it, of which a planner asks nothing beforehand.
    """
    every = F.array(*templates) if several is None else F.concat(F.array(*templates), several) if templates else several
    rows = with_noun(keys) if "instruction" in keys.columns and NOUN not in keys.columns else keys
    whole = rows.select("episode_id", "step", every.alias("_items"))
    each = whole.select("episode_id", "step", F.explode(F.slice("_items", F.lit(1), F.size("_items"))).alias("i"))
    return each.where("i is not null").select("episode_id", "step", "i.rank", "i.tag", "i.question", "i.choices")


def phrase(phase: Column, target: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, (before, after) in PHASE_PHRASES.items():
        out = out.when(phase == name, F.concat(F.lit(before), target, F.lit(after)))
    return out


def target() -> Column:
    return F.coalesce(F.col(NOUN), F.lit("object"))


def gripper_open_item() -> Column:
    return _item(3, "vqa_robot_gripper_open", F.lit("Is the robot's gripper open?"), _binary(F.col("g") <= OPEN_THRESHOLD, "Cannot be determined", "Partially open"))


def gripper_open(keys: DataFrame) -> DataFrame:
    """keys: episode_id, step, g."""
    return made(keys, gripper_open_item())


def object_reachable_item() -> Column:
    noun = F.col(NOUN)
    question = F.concat(F.lit("Is there any obstacle blocking the robot from reaching "), noun, F.lit("?"))
    return _item(4, "vqa_object_reachable", question, _binary(F.lit(False), "Cannot be determined", "Partially reachable"), noun.isNotNull())


def object_reachable(keys: DataFrame) -> DataFrame:
    """keys: episode_id, step, instruction.  No obstacle is ever known, so the answer is No."""
    return made(keys, object_reachable_item())


def task_success_item() -> Column:
    done = (F.col("step") >= F.col("last_start")) & F.col("success")
    question = F.concat(F.lit("The robot is to "), F.lower("instruction"), F.lit(". Has the robot successfully completed the task?"))
    return _item(2, "vqa_task_success_state", question, _binary(done, "Cannot be determined", "Task was not attempted"))


def task_success(keys: DataFrame) -> DataFrame:
    """keys: episode_id, step, instruction, last_start (the last phase run's start), success."""
    return made(keys, task_success_item())


def stable_grasp_item() -> Column:
    question = F.concat(F.lit("Is the robot's grasp of the "), target(), F.lit(" stable?"))
    return _item(1, "is_stable_grasp", question, _binary(F.col("phase") == "contact", "Cannot be determined", "Partially stable"), F.col("phase").isin("contact", "immobilization", "detach"))


def stable_grasp(keys: DataFrame) -> DataFrame:
    """keys: episode_id, step, phase, instruction."""
    return made(keys, stable_grasp_item())


def _phase_choices(right: Column, target: Column) -> Column:
    every = F.array(*[phrase(F.lit(p), target) for p in PHASES])
    return F.concat(F.array(right), F.array_except(every, F.array(right)))


def action_phase_item() -> Column:
    thing = target()
    question = F.concat(
        F.lit("The robot is tasked to "), F.col("instruction"), F.lit(". The robot is interacting with the "), thing, F.lit(". Which phase of the grasp action is shown in the image?")
    )
    return _item(6, "vqa_action_understanding", question, _phase_choices(phrase(F.col("phase"), thing), thing), F.col("phase").isin(*PHASES))


def action_phase(keys: DataFrame) -> DataFrame:
    """keys: episode_id, step, phase, instruction."""
    return made(keys, action_phase_item())


def next_action_item() -> Column:
    thing = target()
    question = F.concat(
        F.lit("The robot is tasked to "), F.col("instruction"), F.lit(". After "), phrase(F.col("phase"), thing), F.lit(", what will be the robot's NEXT action phase?")
    )
    return _item(7, "vqa_next_action", question, _phase_choices(phrase(following_phase(F.col("phase")), thing), thing), F.col("phase").isin(*PHASES))


def next_action(keys: DataFrame) -> DataFrame:
    """keys: episode_id, step, phase, instruction."""
    return made(keys, next_action_item())


def goal_configuration_item(compat: bool = False) -> Column:
    some = F.col("others") > 0
    question = F.concat(F.lit("The robot's task is to "), F.lower("instruction"), F.lit(". Which configuration shows the goal state that the robot should achieve?"))
    choices = F.array(*[F.lit(f"Configuration {x}") for x in "ABCDE"])
    return _item(5, "vqa_goal_configuration", question, choices, some if compat else some & (F.col("step") == F.col("last")))


def goal_configuration(keys: DataFrame, compat: bool = False) -> DataFrame:
    """keys: episode_id, step, instruction, others (the number of keyframes but the last), last.

    The right configuration is the last frame, the others four keyframes in hash order, repeated in a
    cycle where there are fewer.  compat: an item for every keyframe; otherwise one for an episode.
    """
    return made(keys, goal_configuration_item(compat))


def goal_frames(frames: Column, last: Column, episode: Column) -> Column:
    """Steps of the five configurations, the goal first."""
    drawn = F.transform(F.array_sort(F.transform(frames, lambda f: F.struct(digest("goal", episode, f).alias("k"), f.alias("f")))), lambda x: x["f"])
    four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(drawn, (i % F.size(drawn) + 1).cast("int")))
    return F.concat(F.array(last), four)


def temporal_sequence(shown: DataFrame) -> DataFrame:
    """shown: episode_id, step, instruction, phases (of three frames or more).

    Distractors are other orders of the phases, drawn by hash; then swaps and rotations, which complete
    four wherever there are four other orders.
    """
    title = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 100)))
    line = lambda ps: F.array_join(F.transform(ps, title), " → ")
    ps, n = F.col("phases"), F.size("phases")
    places = F.sequence(F.lit(1), n)
    at = lambda i: F.element_at(ps, i)
    swap = lambda i, j: line(F.transform(places, lambda k: at(F.when(k == i, j).when(k == j, i).otherwise(k))))
    right = line(ps)
    drawn = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda d: line(F.transform(F.array_sort(F.transform(ps, lambda p, i: F.struct(digest("order", F.col("episode_id"), d, i).alias("k"), p.alias("p")))), lambda x: x["p"])),
    )
    other = F.filter(places, lambda i: at(i) != at(F.lit(1)))
    same = F.filter(places, lambda i: (at(i) == at(F.lit(1))) & (F.size(other) > 0))
    swaps = F.concat(F.transform(F.slice(other, 1, 4), lambda j: swap(F.lit(1), j)), F.transform(F.slice(same, 1, 5), lambda j: swap(F.get(other, F.lit(0)), j)))
    turns = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: line(F.concat(F.slice(ps, k + 1, n - k), F.slice(ps, F.lit(1), k))))
    others = F.array_remove(F.array_distinct(F.concat(drawn, swaps, turns)), right)
    question = F.concat(F.lit("For the task '"), F.col("instruction"), F.lit("', what is the correct sequence of action phases shown in the images from left to right?"))
    return made(shown, _item(8, "vqa_temporal_sequence", question, F.concat(F.array(right), F.slice(others, 1, 4)), n >= 3))


def instruction_pool() -> list[str]:
    """Every instruction that the templates and the fallback lists give."""
    out = []
    for t in INSTRUCTIONS:
        out += [t.format(o, x) for o in OBJECTS for x in LOCATIONS] if t.count("{}") == 2 else [t.format(o) for o in OBJECTS]
    return out


def trajectory_language_item() -> Column:
    pool = F.array(*[F.lit(x) for x in INSTRUCTIONS])

    def made_up(k: Column) -> Column:
        pick = lambda seed, n: F.pmod(draw(seed, F.col("episode_id"), k), F.lit(n)).cast("int")
        part = F.split(F.element_at(pool, pick("template", len(INSTRUCTIONS)) + 1), r"\{\}")
        thing = F.element_at(F.array(*[F.lit(x) for x in OBJECTS]), pick("object", len(OBJECTS)) + 1)
        place = F.element_at(F.array(*[F.lit(x) for x in LOCATIONS]), pick("place", len(LOCATIONS)) + 1)
        return F.when(F.size(part) == 3, F.concat(part[0], thing, part[1], place, part[2])).otherwise(F.concat(part[0], thing, part[1]))

    others = F.transform(F.array(*[F.lit(x) for x in instruction_pool()[:5]]), lambda x: x)  # should all draws agree
    wrong = F.array_remove(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.lit(15)), made_up), others)), F.col("instruction"))
    question = F.lit("Which language instruction best describes the robot's trajectory shown in the image?")
    told = F.col("instruction").isNotNull() & (F.col("instruction") != "")
    return _item(0, "vqa_trajectory_understanding", question, F.concat(F.array(F.col("instruction")), F.slice(wrong, 1, 4)), told)


def trajectory_language(keys: DataFrame) -> DataFrame:
    """keys: episode_id, step, instruction.  Four wrong instructions: a drawn template, object and place for each of
    sixteen draws, distinct ones first; the first instructions of the pool make up for draws that agree."""
    return made(keys, trajectory_language_item())


def relative_direction(keys: DataFrame, compat: bool = False) -> DataFrame:
    """keys: episode_id, step, camera, instruction, pose, contact_pose (at the first contact; null if none), phase."""
    asked = (F.col("phase") == "pre_grasp") & F.col("contact_pose").isNotNull()
    rows = keys.withColumn("right", direction_label(subtract(F.col("pose"), F.col("contact_pose")), signed=compat))
    others = F.array_remove(F.array(*[F.lit(d) for d in DIRECTIONS]), F.col("right"))
    ranked = F.array_sort(
        F.transform(others, lambda d: F.struct((F.substring(d, 1, 5) != F.substring("right", 1, 5)).alias("far"), digest("direction", F.col("episode_id"), F.col("step"), d).alias("k"), d.alias("d")))
    )
    question = F.concat(
        F.lit("In the image from "), F.col("camera"), F.lit(" at step "), F.col("step").cast("string"), F.lit(", which direction is the "), target(),
        F.lit(" relative to the robot's end effector?"),
    )
    return made(rows, _item(9, "vqa_relative_direction", question, F.concat(F.array("right"), F.transform(F.slice(ranked, 1, 4), lambda x: x["d"])), asked))


def spaced_depths(points: Column, gaps: tuple[float, ...] = (0.05, 0.02, 0.01), tries: int = 100, wanted: int = 5) -> Column:
    """The first ``wanted`` of ``points`` (depth, x, y; in drawn order) whose depths lie apart.

    Each gap gets its own ``tries`` draws; points found under a wider gap are kept.
    """
    none = F.array().cast("array<struct<depth:double,x:int,y:int>>")

    def level(found: Column, k: int, gap: float) -> Column:
        drawn = F.slice(points, 1 + k * tries, tries)
        far = lambda acc, p: ~F.exists(acc, lambda q: F.abs(q["depth"] - p["depth"]) < gap)
        return F.aggregate(drawn, found, lambda acc, p: F.when((F.size(acc) < wanted) & far(acc, p), F.concat(acc, F.array(p))).otherwise(acc))

    out = none
    for k, gap in enumerate(gaps):
        out = level(out, k, gap)
    return out


def spaced_angles(first: Column, candidates: Column, gap: float, wanted: int = 5) -> Column:
    """``first`` and drawn angles that lie at least ``gap`` apart around the circle."""
    from ..functions.geometry import angle_gap

    far = lambda acc, a: ~F.exists(acc, lambda b: angle_gap(a, b) < gap)
    return F.aggregate(candidates, F.array(first), lambda acc, a: F.when((F.size(acc) < wanted) & far(acc, a), F.concat(acc, F.array(a))).otherwise(acc))


COLOURS = ("Red", "Green", "Blue", "Yellow", "Purple")


def _colours(right: Column) -> Column:
    return F.concat(F.array(right), F.array_remove(F.array(*[F.lit(c) for c in COLOURS]), right))


def relative_depth_item(camera: Column, five: Column) -> Column:
    depths = F.transform(five, lambda p: p["depth"])
    closest = draw("ask", F.col("episode_id"), F.col("step"), camera) % 2 == 0
    at = F.array_position(depths, F.when(closest, F.array_min(depths)).otherwise(F.array_max(depths))).cast("int")
    word = F.when(closest, "CLOSEST").otherwise("FARTHEST")
    question = F.concat(F.lit("In the image from "), camera, F.lit(", which colored point is "), word, F.lit(" to the camera?"))
    return _item(10, "vqa_relative_depth", question, _colours(F.element_at(F.array(*[F.lit(c) for c in COLOURS]), at)), F.size(five) == 5)


def relative_depth(keys: DataFrame) -> DataFrame:
    """keys: episode_id, step, camera, five (of ``spaced_depths``, in the order of the colours).  Asks for the closest or, by draw, the farthest."""
    return made(keys, relative_depth_item(F.col("camera"), F.col("five")))


def action_direction_item(camera: Column, seen: Column | None = None, compat: bool = False) -> Column:
    drawn = F.element_at(F.array(*[F.lit(c) for c in COLOURS]), (draw("colour", F.col("episode_id"), F.col("step"), camera) % 5 + 1).cast("int"))
    question = F.concat(F.lit("The robot task is to "), F.col("instruction"), F.lit(". Which colored arrow correctly shows the direction the robot will move next?"))
    return _item(11, "vqa_action_direction_selection", question, _colours(F.lit("Red") if compat else drawn), seen)


def action_direction(keys: DataFrame, compat: bool = False) -> DataFrame:
    """keys: episode_id, step, instruction, camera.  compat: the true arrow is always red; otherwise its colour is drawn."""
    return made(keys, action_direction_item(F.col("camera"), compat=compat))


def quadrant_points(item: Column, right: Column, width: Column, height: Column, margin: int = 40, apart: int = 50) -> Column:
    """Four wrong points (u, v): one in each quadrant but the right point's, then the first drawn point that is far from all.

    Quadrants too small for the margin give none; drawn points make up for them.
    """
    half = lambda x: F.floor(x / 2)
    here = (right["u"] >= half(width)).cast("int") + F.lit(2) * (right["v"] >= half(height)).cast("int")
    none = F.array().cast("array<struct<u:bigint,v:bigint>>")

    def inside(q: Column, size: Column, bit: int) -> tuple[Column, Column]:
        far = F.shiftright(q, bit) % 2 == 1
        return F.when(far, half(size) + margin).otherwise(F.lit(margin)), F.when(far, size - margin).otherwise(half(size) - margin)

    def point(q: Column) -> Column:
        (x0, x1), (y0, y1) = inside(q, width, 0), inside(q, height, 1)
        at = F.struct((x0 + draw("qu", item, q) % (x1 - x0 + 1)).cast("bigint").alias("u"), (y0 + draw("qv", item, q) % (y1 - y0 + 1)).cast("bigint").alias("v"))
        return F.when((q != here) & (x1 - x0 >= 20) & (y1 - y0 >= 20), at)

    first = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(3)), point))
    spare = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.struct((margin + draw("su", item, i) % (width - 2 * margin + 1)).cast("bigint").alias("u"), (margin + draw("sv", item, i) % (height - 2 * margin + 1)).cast("bigint").alias("v")),
    )
    gap = lambda a, b: F.sqrt((a["u"] - b["u"]) * (a["u"] - b["u"]) + (a["v"] - b["v"]) * (a["v"] - b["v"]))
    grown = F.aggregate(
        spare, F.concat(none, first), lambda acc, p: F.when((F.size(acc) < 4) & (gap(p, right) >= apart) & ~F.exists(acc, lambda q: gap(p, q) < apart), F.concat(acc, F.array(p))).otherwise(acc)
    )
    return F.slice(grown, 1, 4)


def correspondence_item(camera1: Column, camera2: Column, right: Column, wrong: Column) -> Column:
    name = F.concat_ws(":", F.col("episode_id").cast("string"), F.col("step").cast("string"), camera1, camera2)
    at = shuffled(F.concat(F.array(right), wrong), name, "points")["correct"]
    letters = F.array(*[F.lit(x) for x in "ABCDE"])
    letter = F.element_at(letters, at + 1)
    question = F.concat(
        F.lit("In the left image ("), camera1, F.lit(" camera), a red dot is marked. Which point is the closest point in the right image ("), camera2,
        F.lit(" camera) corresponding to the same 3D location?"),
    )
    return _item(12, "vqa_multi_view_correspondence", question, F.concat(F.array(letter), F.array_remove(letters, letter)), (F.size(wrong) == 4) & (camera1 != camera2))


def correspondence(keys: DataFrame) -> DataFrame:
    """keys: episode_id, step, camera1, camera2, right (u, v in the second picture), wrong (four points).

    Points are lettered in hash order; the answer is the right one's letter.
    """
    return made(keys, correspondence_item(F.col("camera1"), F.col("camera2"), F.col("right"), F.col("wrong")))


def camera_pair(cameras: Column, item: Column) -> Column:
    """Two different cameras of a list of structs with a name, drawn by hash; null of fewer than two."""
    ranked = F.array_sort(F.transform(cameras, lambda x: F.struct(digest("pair", item, x["camera"]).alias("k"), x.alias("c"))))
    return F.when(F.size(cameras) >= 2, F.struct(ranked[0]["c"].alias("a"), ranked[1]["c"].alias("b")))


def enriched(metadata: Column, vision: Column) -> Column:
    """The item's metadata with a vision model's non-empty values under vlm_ names."""
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(vision, empty), lambda k, v: v.isNotNull() & (v != ""))
    return F.map_concat(F.coalesce(metadata, empty), F.transform_keys(kept, lambda k, v: F.concat(F.lit("vlm_"), k)))
