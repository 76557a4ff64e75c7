"""Engine settings with validation, and the banding tuners."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

import yaml


@dataclass(frozen=True)
class DetectionConfig:
    """Defaults are fixed values of the documented configuration."""

    minhash_threshold: float = 0.7
    simhash_threshold: int = 3
    minhash_bands: int = 16
    minhash_hashes: int = 128
    simhash_tables: int = 4
    min_cluster_size: int = 3
    max_cluster_age_hours: int = 24
    spam_score_threshold: float = 0.6
    bot_score_threshold: float = 0.5
    coordination_threshold: int = 5
    batch_size: int = 1000
    enable_hybrid_mode: bool = True

    def __post_init__(self):
        checks = {
            "minhash_threshold must lie in [0, 1]": 0 <= self.minhash_threshold <= 1,
            "simhash_threshold must lie in [0, 64]": 0 <= self.simhash_threshold <= 64,
            "minhash_hashes must be positive": self.minhash_hashes > 0,
            "minhash_bands must be positive": self.minhash_bands > 0,
            "minhash_bands must divide minhash_hashes": self.minhash_bands > 0 and self.minhash_hashes % self.minhash_bands == 0,
            "min_cluster_size must be 2 or more": self.min_cluster_size >= 2,
            "spam_score_threshold must lie in [0, 1]": 0 <= self.spam_score_threshold <= 1,
            "bot_score_threshold must lie in [0, 1]": 0 <= self.bot_score_threshold <= 1,
        }
        if wrong := [text for text, good in checks.items() if not good]:
            raise ValueError("; ".join(wrong))


def load_config(path: str) -> DetectionConfig:
    """The ``detection`` section of a YAML file (or its top level, if it has none) over the defaults.

    Environment variables expand; other sections are left alone, and a setting that is not
    known, or of a wrong kind, is an error.  A missing file is written with the defaults.
    """
    known = {f.name: type(f.default) for f in fields(DetectionConfig)}
    if not os.path.exists(path):
        with open(path, "w") as out:
            yaml.safe_dump({"detection": {f.name: f.default for f in fields(DetectionConfig)}}, out, sort_keys=False)
        return DetectionConfig()
    with open(path) as lines:
        found = yaml.safe_load(os.path.expandvars(lines.read())) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no settings")
    section = found.get("detection", {k: v for k, v in found.items() if not isinstance(v, dict)}) or {}
    if unknown := sorted(set(section) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    given = {}
    for name, value in section.items():
        kind = known[name]
        if isinstance(value, bool) != (kind is bool) or not isinstance(value, (bool, int, float)) or kind is int and value != int(value):
            raise ValueError(f"{name} must be of type {kind.__name__}")
        given[name] = kind(value)
    return DetectionConfig(**given)


def banding(threshold: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the divisor of ``hashes`` whose collision probability at the threshold is nearest to it; ties to fewer bands."""
    divisors = [b for b in range(1, hashes + 1) if hashes % b == 0]
    return min(((b, hashes // b) for b in divisors), key=lambda br: (abs(1 - (1 - threshold ** br[1]) ** br[0] - threshold), br[0]))


def heuristic_bands(threshold: float, hashes: int = 128) -> int:
    """32, 16 or 8 bands by threshold, lowered until they divide the hashes."""
    bands = 32 if threshold >= 0.8 else 16 if threshold >= 0.6 else 8
    return next(b for b in range(bands, 0, -1) if hashes % b == 0)
