"""Thresholds of quality control from YAML with ``${NAME}`` interpolation."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class QcConfig:
    """Shares are from 0 to 1; ``neighbours`` at least 1."""

    sample_missing: float = 0.1
    probe_missing: float = 0.2
    largest: float = 0.96
    correlation: float = 0.9
    imputer: str = "mean"
    neighbours: int = 5
    target: str = "beta"

    def __post_init__(self) -> None:
        for name in ("sample_missing", "probe_missing", "largest"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is from 0 to 1")
        if not -1 <= self.correlation <= 1 or self.neighbours < 1:
            raise ValueError("correlation is from -1 to 1, neighbours at least 1")

    @classmethod
    def from_mapping(cls, values: Mapping) -> QcConfig:
        """Unknown keys are left out."""
        known = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: known[k](v) for k, v in values.items() if k in known})

    @classmethod
    def from_text(cls, text: str, env: Mapping[str, str] | None = None) -> QcConfig:
        """Flat ``key: value`` lines; a variable that is not set is an error."""
        env = os.environ if env is None else env

        def value(m: re.Match) -> str:
            if m[1] not in env:
                raise KeyError(f"variable {m[1]} is not set")
            return env[m[1]]

        out = {}
        for line in re.sub(r"\$\{(\w+)\}", value, text).splitlines():
            line = line.split("#")[0].strip()
            if not line:
                continue
            if ":" not in line:
                raise ValueError("the file is no mapping")
            k, v = line.split(":", 1)
            if v.strip():
                out[k.strip()] = v.strip().strip("\"'")
        return cls.from_mapping(out)

    @classmethod
    def from_file(cls, path: str, env: Mapping[str, str] | None = None) -> QcConfig | None:
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return cls.from_text(f.read(), env)
