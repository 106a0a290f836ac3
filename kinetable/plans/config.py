"""Run settings: defaults, overlaid by the sections of a mapping or a YAML or JSON file; unknown keys are ignored."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Generation:
    datasets: tuple[str, ...] = ()
    num_episodes: int | None = None
    grasp_threshold: float = 0.2
    contact_threshold: float = 0.9
    compat: bool = False


@dataclass(frozen=True)
class Build:
    train: int = 1_000_000
    test: int = 10_000
    images: bool = True
    longest: int = 1280


@dataclass(frozen=True)
class Training:
    validation_split: float = 0.05
    max_train_samples: int | None = None
    random_state: int = 3407


@dataclass(frozen=True)
class Evaluation:
    max_test_samples: int = 10_000
    batch_size: int = 96
    use_cache: bool = True
    fallback_percent: int = 20
    models: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    generation: Generation = field(default_factory=Generation)
    build: Build = field(default_factory=Build)
    training: Training = field(default_factory=Training)
    evaluation: Evaluation = field(default_factory=Evaluation)


def overlay(base: Config, sections: dict) -> Config:
    out = {}
    for part in fields(base):
        own = getattr(base, part.name)
        names = {f.name for f in fields(own)}
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in (sections.get(part.name) or {}).items() if k in names}
        out[part.name] = replace(own, **given)
    return Config(**out)


def load(path: str, base: Config | None = None) -> Config:
    """JSON, or YAML where a parser is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML parser is installed; give JSON") from e
        return overlay(base or Config(), yaml.safe_load(text) or {})
    return overlay(base or Config(), json.loads(text))
