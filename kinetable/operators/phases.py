"""Grasp phases: normalisation, the state machine, intervals and look-ups over the step axis.

``steps`` has columns episode_id, step and gripper.  Two physical forms of the state machine agree:

* ``phase_runs`` - one exchange on the episode: normalising window, sorted array, native fold.  The fold
  appends an entry only where the phase changes, so it is linear in the episode's length.
* ``phase_runs_blocked`` - for episodes too long for one task.  Steps are dealt by (episode, block); each
  block is folded from every state it could be entered in, the few block results of an episode are
  chained, and each block is folded once more from its true entry state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw

PHASES = ("pre_grasp", "immobilization", "contact", "detach", "post_grasp")
GRASP = 0.2
CONTACT = 0.9
EPSILON = 1e-6


def episode(*order: str):
    w = Window.partitionBy("episode_id")
    return w.orderBy(*order) if order else w


def normalize(steps: DataFrame) -> DataFrame:
    """Adds g: the gripper scaled by the episode's range, which always takes in -1..1 from inside.

    The largest value counts as -1 at least, the smallest as 1 at most.  NaN becomes null.
    """
    value = F.when(~F.isnan("gripper"), F.col("gripper"))
    high = F.greatest(F.lit(-1.0), F.max(value).over(episode()))
    low = F.least(F.lit(1.0), F.min(value).over(episode()))
    return steps.withColumn("g", (value - low) / (high - low + EPSILON))


def next_phase(phase: Column, g: Column, before: Column, grasp: float = GRASP, contact: float = CONTACT) -> Column:
    """The phase after a step, from the phase before it, its reading and the last one."""
    up, down = g > before, g < before
    return (
        F.when((phase == "pre_grasp") & (g > grasp) & up, "immobilization")
        .when((phase == "immobilization") & (g >= contact), "contact")
        .when((phase == "immobilization") & (g <= grasp) & down, "pre_grasp")
        .when((phase == "contact") & (g < contact) & down, "detach")
        .when((phase == "detach") & (g <= grasp), "post_grasp")
        .when((phase == "detach") & (g >= contact) & up, "contact")
        .when((phase == "post_grasp") & (g > grasp) & up, "immobilization")
        .otherwise(phase)
    )


def _fold(rows: Column, phase: Column, before: Column, grasp: float, contact: float) -> Column:
    """Runs (start, phase) of steps ``rows`` (step, g) entered in ``phase`` after reading ``before``.

    A step in contact below the threshold that rises can only follow a missing reading; it is a
    ``transition`` of one step.
    """
    run = lambda step, name: F.struct(step.alias("start"), name.alias("phase"))
    first = F.struct(phase.alias("phase"), before.alias("before"), F.lit(None).cast("string").alias("shown"), F.array().cast("array<struct<start:int,phase:string>>").alias("runs"))

    def step(acc: Column, x: Column) -> Column:
        g = x["g"]
        new = next_phase(acc["phase"], g, acc["before"], grasp, contact)
        odd = (acc["phase"] == "contact") & (g < contact) & (g > acc["before"])
        shown = F.when(odd, F.lit("transition")).otherwise(new)
        runs = F.when(shown.eqNullSafe(acc["shown"]), acc["runs"]).otherwise(F.concat(acc["runs"], F.array(run(x["step"], shown))))
        return F.struct(new.alias("phase"), g.alias("before"), shown.alias("shown"), runs.alias("runs"))

    return F.aggregate(rows, first, step)


def _spread(runs: Column, last: Column) -> Column:
    """(start, end, phase) of runs (start, phase); the last ends at ``last``."""
    return F.transform(
        runs, lambda r, i: F.struct(r["start"].alias("start"), (F.coalesce(F.try_element_at(runs, i + 2)["start"], last + 1) - 1).alias("end"), r["phase"].alias("phase"))
    )


def phase_runs(steps: DataFrame, grasp: float = GRASP, contact: float = CONTACT) -> DataFrame:
    """episode_id, start, end, phase: maximal runs of equal phase, which cover each episode."""
    rows = normalize(steps).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct(F.col("step").cast("int").alias("step"), "g"))).alias("rows"))
    folded = _fold(F.col("rows"), F.lit("pre_grasp"), F.col("rows")[0]["g"], grasp, contact)
    runs = rows.select("episode_id", folded["runs"].alias("runs"), F.element_at("rows", -1)["step"].alias("last"))
    return runs.select("episode_id", F.explode(_spread(F.col("runs"), F.col("last"))).alias("r")).select("episode_id", "r.start", "r.end", "r.phase")


def phase_runs_blocked(steps: DataFrame, block: int = 4096, grasp: float = GRASP, contact: float = CONTACT) -> DataFrame:
    """The same runs for episodes of any length; a run that crosses blocks is joined again."""
    value = F.when(~F.isnan("gripper"), F.col("gripper"))
    part = F.floor(F.col("step") / block).cast("int")
    blocks = (
        steps.select("episode_id", part.alias("block"), F.col("step").cast("int").alias("step"), value.alias("v"))
        .groupBy("episode_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("step", "v"))).alias("rows"))
    )
    bounds = steps.groupBy("episode_id").agg(F.greatest(F.lit(-1.0), F.max(value)).alias("high"), F.least(F.lit(1.0), F.min(value)).alias("low"))
    scaled = blocks.join(bounds, "episode_id").select(
        "episode_id", "block", F.transform("rows", lambda x: F.struct(x["step"].alias("step"), ((x["v"] - F.col("low")) / (F.col("high") - F.col("low") + EPSILON)).alias("g"))).alias("rows")
    )
    order = episode("block")
    edges = scaled.select("episode_id", "block", F.element_at("rows", -1)["g"].alias("last_g"), F.lag(F.element_at("rows", -1)["g"]).over(order).alias("before"))
    entered = scaled.join(edges.select("episode_id", "block", "before"), ["episode_id", "block"]).withColumn(
        "before", F.when(F.col("block") == 0, F.col("rows")[0]["g"]).otherwise(F.col("before"))
    )
    exits = F.create_map(*[x for p in PHASES for x in (F.lit(p), _fold(F.col("rows"), F.lit(p), F.col("before"), grasp, contact)["phase"])])
    chain = entered.select("episode_id", F.struct("block", exits.alias("exits")).alias("b")).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("b.block", F.map_entries("b.exits").alias("exits")))).alias("chain"))
    walked = F.aggregate(
        "chain",
        F.struct(F.lit("pre_grasp").alias("phase"), F.array().cast("array<struct<block:int,entry:string>>").alias("seen")),
        lambda acc, b: F.struct(
            F.try_element_at(F.map_from_entries(b["exits"]), acc["phase"]).alias("phase"), F.concat(acc["seen"], F.array(F.struct(b["block"].alias("block"), acc["phase"].alias("entry")))).alias("seen")
        ),
    )
    entries = chain.select("episode_id", F.explode(walked["seen"]).alias("s")).select("episode_id", "s.block", "s.entry")
    folded = _fold(F.col("rows"), F.col("entry"), F.col("before"), grasp, contact)
    runs = entered.join(entries, ["episode_id", "block"]).select("episode_id", folded["runs"].alias("runs"), F.element_at("rows", -1)["step"].alias("last"))
    pieces = runs.select("episode_id", F.explode(_spread(F.col("runs"), F.col("last"))).alias("r")).select("episode_id", "r.start", "r.end", "r.phase")
    fresh = F.coalesce((F.lag("phase").over(episode("start")) != F.col("phase")).cast("int"), F.lit(1))
    return (
        pieces.withColumn("run", F.sum(fresh).over(episode("start")))
        .groupBy("episode_id", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("phase").alias("phase"))
        .select("episode_id", "start", "end", "phase")
    )


def key_steps(steps: DataFrame, seed: str = "keyframe", grasp: float = GRASP, contact: float = CONTACT, also: tuple[str, ...] = ()) -> DataFrame:
    """episode_id, step, g, phase, last_start, last, others, frames of every keyframe, by one exchange and one fold.

    Keyframes are one drawn step for each phase run, the first and the last, where there is such a step;
    ``last_start`` is the last run's start, ``last`` the last step, ``others`` the number of keyframes but the last and
    ``frames`` these themselves, at the last only.  Columns ``also`` of the steps come along, and those of the next step
    as next_...; null at the end.  A keyframe's row is found by position, by a search only where steps are missing.
    """
    entry = F.struct(F.col("step").cast("int").alias("step"), "g", *also)
    rows = normalize(steps).groupBy("episode_id").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    folded = _fold(F.transform("rows", lambda r: F.struct(r["step"].alias("step"), r["g"].alias("g"))), F.lit("pre_grasp"), F.col("rows")[0]["g"], grasp, contact)["runs"]
    spread = rows.select("episode_id", "rows", folded.alias("runs")).select("episode_id", "rows", _spread(F.col("runs"), F.element_at("rows", -1)["step"]).alias("runs"))
    whole = spread.select("episode_id", F.explode(F.array(F.struct("rows", "runs"))).alias("e")).select("episode_id", "e.rows", "e.runs")  # folded once

    def key(step: Column, run: Column) -> Column:
        return F.struct(step.cast("int").alias("step"), run["phase"].alias("phase"))

    span = lambda r: r["end"] - r["start"]
    drawn = F.transform("runs", lambda r: key(F.when(span(r) == 0, r["start"]).otherwise(r["start"] + F.pmod(draw(seed, F.col("episode_id"), r["start"]), span(r))), r))
    last = F.element_at("rows", -1)["step"]
    ends = F.array(key(F.lit(0), F.col("runs")[0]), key(last, F.element_at("runs", -1)))
    keys = whole.withColumns({"last": last, "last_start": F.element_at("runs", -1)["start"], "keys": F.array_sort(F.array_distinct(F.concat(drawn, ends)))})
    keys = keys.withColumns({"others": F.size("keys") - 1, "key": F.explode("keys")})

    def row_at(step: Column) -> Column:
        near = F.get("rows", step - F.col("rows")[0]["step"])
        return F.when(near["step"] == step, near).otherwise(F.get(F.filter("rows", lambda r: r["step"] == step), F.lit(0)))

    frames = F.when(F.col("key.step") == F.col("last"), F.filter(F.transform("keys", lambda k: k["step"]), lambda k: k != F.col("last")))
    found = keys.select("episode_id", row_at(F.col("key.step")).alias("x"), row_at(F.col("key.step") + 1).alias("y"), F.col("key.phase").alias("phase"), "last_start", "last", "others", frames.alias("frames"))
    more = [F.col(f"x.{c}").alias(c) for c in also] + [F.col(f"y.{c}").alias(f"next_{c}") for c in also]
    return found.where("x is not null").select("episode_id", F.col("x.step").alias("step"), F.col("x.g").alias("g"), "phase", "last_start", "last", "others", "frames", *more)


def phase_steps(runs: DataFrame) -> DataFrame:
    """episode_id, step, phase of every step that a run covers."""
    return runs.select("episode_id", F.explode(F.sequence("start", "end")).alias("step"), "phase")


def phase_lookup(wanted: DataFrame, runs: DataFrame, lengths: DataFrame) -> DataFrame:
    """The phase of wanted (episode_id, step) pairs; out_of_range beyond the episode, else unknown."""
    found = wanted.join(phase_steps(runs), ["episode_id", "step"], "left").join(lengths, "episode_id", "left")
    outside = (F.col("step") < 0) | (F.col("step") >= F.col("length"))
    return found.select("episode_id", "step", F.coalesce("phase", F.when(outside, F.lit("out_of_range")), F.lit("unknown")).alias("phase"))


def following_phase(phase: Column) -> Column:
    """The next of the five phases, cyclically; null for anything else."""
    order = F.array(*[F.lit(p) for p in PHASES])
    at = F.array_position(order, phase)
    return F.when(at > 0, F.element_at(order, (at % 5 + 1).cast("int")))
