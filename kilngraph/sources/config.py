"""Configuration: nested dictionaries with ${NAME:default} interpolation and dotted access."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

_SLOT = re.compile(r"\$\{(\w+)(?::([^}]*))?\}")


def interpolate(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """Replace ${NAME:default} in every string of a nested value; without a value or default the slot becomes ''."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return _SLOT.sub(lambda m: env.get(m[1], m[2] if m[2] is not None else ""), value)
    if isinstance(value, Mapping):
        return {k: interpolate(v, env) for k, v in value.items()}
    return [interpolate(v, env) for v in value] if isinstance(value, list) else value


class Config:
    def __init__(self, values: Mapping[str, Any], env: Mapping[str, str] | None = None):
        self.values = interpolate(dict(values), env)

    @classmethod
    def load(cls, path: str) -> Config:
        """From YAML if its reader is installed, else from JSON."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        try:
            import yaml
        except ImportError:
            import json

            return cls(json.loads(text))
        return cls(yaml.safe_load(text) or {})

    def get(self, key: str, default: Any = None) -> Any:
        """``a.b.c``; a missing or null value gives the default."""
        at: Any = self.values
        for part in key.split("."):
            if not isinstance(at, Mapping) or at.get(part) is None:
                return default
            at = at[part]
        return at

    def apply(self, spark, prefix: str = "spark") -> None:
        """Set the flat entries below ``prefix`` on the session."""
        for key, value in (self.get(prefix) or {}).items():
            spark.conf.set(f"spark.{key}", str(value))
