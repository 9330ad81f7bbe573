"""Settings of a run: a table of what the engine reads, checked key by key.

A file is YAML with a mapping for each section; ``extends: other.yaml`` lays it over one
other file, which may not extend a third.  Unknown sections and keys are errors.  Settings
of single-machine execution (workers, buffers, devices) are accepted, so that existing
files load, and have no effect: Spark's own configuration decides those.
"""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace
from typing import Any

# Section, key, default and what is allowed.  A pair of numbers is a closed
# range (None: open), a tuple of strings a choice, a type that type; "?" also allows null.
SETTINGS = (
    ("project", "seed", 2026, int),
    ("validation", "strategy", "official_random_event", ("official_random_event", "legacy_global_cutoff")),
    ("validation", "days", 7, (1, None)),
    ("validation", "seed", 42, int),
    ("validation", "training_cutoff_timestamp_ms", None, "?int"),
    ("validation", "cutoff_timestamp_ms", None, "?int"),
    ("validation", "top_k", 20, (1, 20)),
    ("validation", "minimum_rules_recall_at_20", 0.54, (0.0, 1.0)),
    ("validation", "minimum_candidate_recall_at_100", 0.62, (0.0, 1.0)),
    ("validation", "enforce_quality_gate", True, bool),
    ("candidates", "total_budget", 250, (20, None)),
    ("candidates", "history_budget", 50, (0, None)),
    ("candidates", "popularity_budget", 40, (0, None)),
    ("candidates", "covisitation_budget", 180, (0, None)),
    ("covisitation", "profile", "public_v575", ("public_v575", "legacy_five")),
    ("covisitation", "max_events_per_session", 30, "?2"),
    ("covisitation", "max_neighbors", 80, (1, None)),
    ("ranking", "max_depth", 5, (1, None)),
    ("ranking", "learning_rate", 0.1, (1e-9, None)),
    ("ranking", "rounds", 20, (1, None)),
    ("ranking", "training_candidate_limit", 80, (20, None)),
    ("ranking", "validation_candidate_limit", 120, (20, None)),
    ("ranking", "training_query_limit", 50_000, (1, None)),
    ("ranking", "validation_query_limit", 50_000, (1, None)),
    ("ranking", "clicks_negative_sample_rate", 0.05, (1e-9, 1.0)),
    ("ranking", "carts_negative_sample_rate", 0.25, (1e-9, 1.0)),
    ("ranking", "orders_negative_sample_rate", 0.40, (1e-9, 1.0)),
    ("ranking", "model_strategy", "validated", ("validated", "refit")),
)
# Accepted, without effect here.  A section without keys takes any.
NO_EFFECT = {
    "project": ("artifacts_dir", "data_dir"),
    "candidates": ("workers", "chunk_sessions"),
    "covisitation": ("partitions", "pair_buffer_size", "batch_rows", "reduction_workers"),
    "ranking": ("device", "nthread"),
    "neural": (),
}


def _problem(value: Any, default: Any, allowed: Any) -> str | None:
    """What is wrong with a value, if anything."""
    if isinstance(allowed, str):
        if value is None:
            return None
        allowed = (2, None) if allowed == "?2" else int
    if isinstance(allowed, type):
        return None if type(value) is allowed else f"is not of type {allowed.__name__}"
    if isinstance(allowed[0], str):
        return None if value in allowed else f"is none of {', '.join(allowed)}"
    kinds = (int, float) if isinstance(default, float) else (int,)
    if type(value) not in kinds:
        return "is not a number" if float in kinds else "is not a whole number"
    low, high = allowed
    if value < low or (high is not None and value > high):
        return f"is not between {low:g} and {'any' if high is None else f'{high:g}'}"
    return None


def _section(name: str, own: Any) -> dict[str, Any]:
    if own is not None and not isinstance(own, dict):
        raise ValueError(f"section {name} is not a mapping")
    return own or {}


class Config:
    """Sections as attributes: ``Config(ranking={"rounds": 3}).ranking.rounds``."""

    def __init__(self, **sections: dict[str, Any] | None):
        given = {name: dict(_section(name, own)) for name, own in sections.items()}
        faults, self._values = [], {}
        for section, key, default, allowed in SETTINGS:
            value = given.get(section, {}).pop(key, default)
            if wrong := _problem(value, default, allowed):
                faults.append(f"{section}.{key} = {value!r} {wrong}")
            self._values.setdefault(section, {})[key] = value
        for section, own in given.items():
            if section not in self._values and section not in NO_EFFECT:
                faults.append(f"there is no section {section}")
                continue
            free = NO_EFFECT.get(section, ())
            faults += [f"there is no setting {section}.{key}" for key in own if key not in free and section in self._values]
        v = self._values["validation"]
        cuts = [v["training_cutoff_timestamp_ms"], v["cutoff_timestamp_ms"]]
        if not faults and v["strategy"] == "legacy_global_cutoff" and None not in cuts and cuts[0] >= cuts[1]:
            faults.append("validation: the ranker's training window has to end before the validation window does")
        if faults:
            raise ValueError("; ".join(faults))
        for section, own in self._values.items():
            setattr(self, section, SimpleNamespace(**own))

    def as_dict(self) -> dict[str, dict[str, Any]]:
        return {section: dict(own) for section, own in self._values.items()}


def load(path: str | Path) -> Config:
    import yaml

    def read(at: Path) -> dict[str, Any]:
        return yaml.safe_load(at.read_text()) or {}

    path = Path(path)
    own = read(path)
    base: dict[str, Any] = {}
    if parent := own.pop("extends", None):
        base = read(path.parent / parent)
        if "extends" in base:
            raise ValueError(f"{parent} extends another file; only one level is allowed")
    return Config(**{name: {**_section(name, base.get(name)), **_section(name, own.get(name))} for name in {**base, **own}})
