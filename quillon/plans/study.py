"""The control plane: study configuration, pinned inventories, and what a run was run with.  These are driver-side
documents of a few kilobytes; tables never pass through here."""

from __future__ import annotations

import hashlib
import json
import platform
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import SparkSession

SCHEMA_VERSION = "quillon-study-1"


def canonical_digest(payload) -> str:
    """sha256 of JSON with sorted keys and no spaces; NaN and infinities are refused."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def load_pinned(path: str, sha256: str | None = None) -> dict:
    """A JSON object, optionally with the digest that its bytes must have."""
    raw = Path(path).read_bytes()
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError(f"{path} doesn't have the pinned digest")
    found = json.loads(raw)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def number(value, low: float, high: float, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
        raise ValueError(f"{name} must be a number in [{low}, {high}]")
    return value


def whole(value, low: int, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < low:
        raise ValueError(f"{name} must be a whole number of at least {low}")
    return value


@dataclass(frozen=True)
class Study:
    """A validated study; unknown fields and another schema version are refused."""

    modes: tuple[str, ...]
    alphas: tuple[float, ...]
    bootstrap_iterations: int = 10_000
    bootstrap_seed: int = 0
    confidence: float = 0.95
    candidate_layers: int = 3
    overall_auroc: float = 0.7
    mode_auroc: float = 0.65
    unevaluable_modes: int = 1
    control_quantile: float = 0.95
    controls: int = 100
    fit_share: float = 0.2
    probe_share: float = 0.1
    evaluation_share: float = 0.5
    prompts: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.modes or len(set(self.modes)) != len(self.modes):
            raise ValueError("modes must be different, and there must be one")
        if 0.0 not in self.alphas or len(set(self.alphas)) != len(self.alphas):
            raise ValueError("alphas must be different, with 0 among them")
        for name in ("confidence", "overall_auroc", "mode_auroc", "control_quantile", "fit_share", "probe_share", "evaluation_share"):
            number(getattr(self, name), 0, 1, name)
        for name in ("bootstrap_iterations", "candidate_layers", "controls"):
            whole(getattr(self, name), 1, name)
        for name in ("bootstrap_seed", "unevaluable_modes"):
            whole(getattr(self, name), 0, name)
        if self.fit_share + self.probe_share + self.evaluation_share > 1:
            raise ValueError("split shares are over 1")

    @classmethod
    def load(cls, path: str, sha256: str | None = None) -> Study:
        found = load_pinned(path, sha256)
        if found.pop("schema_version", None) != SCHEMA_VERSION:
            raise ValueError("another schema version")
        if extra := set(found) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown fields: {sorted(extra)}")
        return cls(**{k: tuple(v) if k in ("modes", "alphas") else v for k, v in found.items()})


def runtime(spark: SparkSession) -> dict:
    """Versions and session settings, for a run's report."""
    settings = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith(("spark.sql.", "spark.executor.", "spark.master"))}
    return {"spark": spark.version, "python": platform.python_version(), "master": spark.sparkContext.master, "settings": dict(sorted(settings.items()))}


def with_launch_digest(identity: dict) -> dict:
    """A launch's identity with the digest of everything else in it."""
    body = {k: v for k, v in identity.items() if k != "launch_sha256"}
    return body | {"launch_sha256": canonical_digest(body)}


def check_launch(identity: dict, study_sha256: str | None = None) -> dict:
    """The identity, if its digest is that of its body and it is bound to the study."""
    if with_launch_digest(identity) != identity:
        raise ValueError("the launch digest isn't that of its body")
    if study_sha256 is not None and identity.get("study_sha256") != study_sha256:
        raise ValueError("the launch belongs to another study")
    return identity


def stage_arguments(kind: str, limit: int | None, batch: int | None) -> tuple[int | None, int | None]:
    """A confirmatory run takes all records and the study's batch size; only a smoke run is cut short or has another one."""
    if kind not in ("smoke", "confirmatory"):
        raise ValueError(f"unknown kind of run: {kind}")
    for name, value in (("limit", limit), ("batch", batch)):
        if value is not None:
            whole(value, 1, name)
            if kind != "smoke":
                raise ValueError(f"{name} is for smoke runs alone")
    if kind == "smoke" and limit is None:
        raise ValueError("a smoke run needs a limit")
    return limit, batch


def task_contract(found: dict, pinned: dict) -> dict:
    """A task's settings, equal to the study's field by field; what differs is named."""
    if wrong := sorted(k for k in found.keys() | pinned.keys() if type(found.get(k)) is not type(pinned.get(k)) or found.get(k) != pinned.get(k)):
        raise ValueError(f"the task differs from the study in {wrong}")
    return found
