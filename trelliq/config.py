"""Settings of the two cleaning presets; unknown keys are refused."""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


class DatasetIntegrityError(ValueError):
    """A table does not hold what its loader expects."""


@dataclass(frozen=True)
class Filters:
    least_tokens: int = 6
    least_words: int = 8
    high_reuse: int = 20
    false_negative_percentile: float = 0.05
    false_negative_threshold: float | None = None
    sample_size: int = 150


@dataclass(frozen=True)
class Splits:
    shares: tuple[float, ...] = (0.8, 0.1, 0.1)
    by_component: bool = True
    near_duplicate_threshold: float | None = None
    budget: int = 8
    mining_cap: float = 0.95
    least_survivors: int = 8000


@dataclass(frozen=True)
class Settings:
    name: str = "components"
    seed: int = 590
    filters: Filters = field(default_factory=Filters)
    splits: Splits = field(default_factory=Splits)


#: The two presets differ in their rules, so their figures are never to be mixed.
COMPONENTS = Settings()
PARTITIONS = Settings("partitions", 42, Filters(false_negative_threshold=0.71), Splits(by_component=False, near_duplicate_threshold=0.95))


def settings_from(given: dict, kind: type = Settings):
    """A settings object; TypeError for an unknown key, lists become tuples, sections are filled with defaults."""
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(given) - set(known)):
        raise TypeError(f"unknown settings of {kind.__name__}: {unknown}")
    values = {}
    for key, value in given.items():
        section = {"filters": Filters, "splits": Splits}.get(key)
        values[key] = settings_from(value, section) if section else tuple(value) if isinstance(value, list) else value
    return kind(**values)


def load_settings(path: str) -> Settings:
    """Settings of a YAML or JSON file; the defaults where there is no file."""
    if not Path(path).exists():
        return Settings()
    text = Path(path).read_text()
    if path.endswith(".json"):
        return settings_from(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML settings needs the yaml package; JSON works without it") from e
    return settings_from(yaml.safe_load(text) or {})


def as_dict(settings) -> dict:
    return asdict(settings) if is_dataclass(settings) else settings


def run_name(settings: Settings) -> str:
    return f"{settings.name}-seed{settings.seed}-budget{settings.splits.budget}"


def seed_all(seed: int) -> None:
    """Seed the generators of the driver's own Python code; queries draw from hashes of their seed and need none."""
    import numpy as np

    random.seed(seed)
    np.random.seed(seed % (1 << 32))
