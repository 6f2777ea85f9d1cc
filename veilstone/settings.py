"""Settings from the environment: VEILSTONE_PROFILE, VEILSTONE_CATEGORIES and so on, each with the field's own type."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from veilstone.functions import catalog
from veilstone.operators.redact import Options

PREFIX = "VEILSTONE_"


@dataclass(frozen=True)
class Settings:
    """What an installation decides. Lists are written with commas."""

    profile: str = "rule"
    categories: tuple[str, ...] = ()
    skip_categories: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    skip_labels: tuple[str, ...] = ()
    consistent: bool = True
    strict: bool = False
    threshold: float = catalog.SCORE_THRESHOLD
    context_boost: float = 0.0
    longest_text: int = 500_000
    most_bytes: int = 1 << 20
    most_texts: int = 500
    breaker_threshold: int = 10
    breaker_recovery_seconds: int = 30
    cache_seconds: int = 300
    sample_percent: int = 5

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Unset variables leave the defaults; unknown ones with the prefix and values of a wrong type are errors."""
        env = os.environ if env is None else env
        held = {k.removeprefix(PREFIX).lower(): v for k, v in env.items() if k.startswith(PREFIX)}
        own = {f.name: f for f in fields(cls)}
        if unknown := held.keys() - own.keys():
            raise KeyError(f"no such setting: {', '.join(sorted(unknown))}")
        out = cls(**{k: _read(k, v, type(own[k].default)) for k, v in held.items()})
        if out.profile not in ("rule", "scored"):
            raise ValueError(f"no such profile: {out.profile}")
        return out

    def options(self) -> Options:
        return Options(self.profile, None, self.categories, self.skip_categories, self.labels, self.skip_labels, self.consistent, self.strict, self.threshold, context_boost=self.context_boost)


def _read(name: str, value: str, kind: type):
    if kind is tuple:
        return tuple(x.strip() for x in value.split(",") if x.strip())
    if kind is bool:
        if value.lower() not in ("1", "0", "true", "false", "yes", "no"):
            raise ValueError(f"{name}: {value!r} is neither true nor false")
        return value.lower() in ("1", "true", "yes")
    return kind(value)
