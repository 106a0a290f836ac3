"""Grasp phases over a stream of steps.

An extension: batch normalisation needs whole episodes, so the stream takes fixed gripper bounds.
State is one small struct an episode; steps of an episode must arrive in order of step within and
across micro-batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.phases import CONTACT, EPSILON, GRASP

OUT = "episode_id long, step int, g double, phase string"
STATE = "phase string, before double"


def advance(phase: str, g: float, before: float, grasp: float = GRASP, contact: float = CONTACT) -> str:
    """The phase after a reading; missing readings compare false."""
    up, down = g > before, g < before
    if phase in ("pre_grasp", "post_grasp"):
        return "immobilization" if g > grasp and up else phase
    if phase == "immobilization":
        return "contact" if g >= contact else "pre_grasp" if g <= grasp and down else phase
    if phase == "contact":
        return "detach" if g < contact and down else phase
    return "post_grasp" if g <= grasp else "contact" if g >= contact and up else phase


def stream_phases(steps: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """episode_id, step, g, phase as steps (episode_id, step, gripper) arrive."""

    def run(key, frames, state):
        phase, before = state.get if state.exists else ("pre_grasp", float("nan"))
        rows = pd.concat(list(frames)).sort_values("step")
        out = []
        for step, value in zip(rows["step"], rows["gripper"], strict=True):
            g = (value - low) / (high - low + EPSILON)
            phase = advance(phase, g, before)
            before = g
            out.append((key[0], step, g, phase))
        state.update((phase, float(before)))
        yield pd.DataFrame(out, columns=["episode_id", "step", "g", "phase"])

    return steps.groupBy("episode_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
