"""Settings: defaults, then a TOML file, then ``STRATAFRAME_*`` variables, then what the caller gives."""

from __future__ import annotations

import os
import tomllib
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

from .schemas import OFFICIAL_DIMENSIONS


@dataclass(frozen=True)
class Config:
    dimension: int = 64
    chunk_overlap: int = 5
    context_limit: int = 8192
    hub_weight: float = 0.3
    max_chunks_per_doc: int = 3
    image_mode: str = "text"
    recover_hours: int = 24
    remote_images: bool = False
    allowed_domains: tuple[str, ...] = ()
    #: Cells that a vector search looks into at least, once ``reindex`` has made them; 0: all vectors, exactly.
    probes: int = 16
    lock_seconds: float = 300.0

    def problems(self) -> list[str]:
        """What is out of range; such values only warn."""
        out = []
        if self.dimension not in OFFICIAL_DIMENSIONS:
            out.append(f"dimension {self.dimension} isn't one of {OFFICIAL_DIMENSIONS}")
        if not 0 <= self.hub_weight <= 1:
            out.append(f"hub_weight {self.hub_weight} isn't between 0 and 1")
        for name in ("chunk_overlap", "max_chunks_per_doc", "recover_hours", "context_limit", "probes", "lock_seconds"):
            if getattr(self, name) < 0:
                out.append(f"{name} is negative")
        return out


def _typed(name: str, value):
    default = getattr(Config(), name)
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        return tuple(v for v in (value.split(",") if isinstance(value, str) else value) if v)
    return type(default)(value)


def load(given: Mapping[str, object] | None = None, bundle: str | None = None, env: Mapping[str, str] | None = None) -> Config:
    """The settings in force; ``None`` in ``given`` means not given, so any other value overrides, 0 included."""
    env = os.environ if env is None else env
    names = {f.name for f in fields(Config)}
    layers: dict[str, object] = {}
    for folder in (Path.cwd(), *([Path(bundle)] if bundle else []), Path.home()):
        if (path := folder / "strataframe.toml").is_file():
            layers |= {k: v for k, v in tomllib.loads(path.read_text()).items() if k in names}
            break
    layers |= {n: env[f"STRATAFRAME_{n.upper()}"] for n in names if f"STRATAFRAME_{n.upper()}" in env}
    layers |= {k: v for k, v in (given or {}).items() if k in names and v is not None}
    config = replace(Config(), **{k: _typed(k, v) for k, v in layers.items()})
    for problem in config.problems():
        warnings.warn(problem, stacklevel=2)
    return config
