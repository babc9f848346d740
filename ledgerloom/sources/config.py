"""Settings with their defaults, from a mapping, a JSON file or the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from ledgerloom.functions import rules


def _leaves(values: dict) -> dict:
    """Settings of all groups side by side; a name in two groups is an error, not a matter of order."""
    out: dict = {}
    for k, v in values.items():
        for name, leaf in (_leaves(v) if isinstance(v, dict) else {k: v}).items():
            if name in out:
                raise ValueError(f"setting {name} occurs twice")
            out[name] = leaf
    return out


@dataclass(frozen=True)
class Config:
    top_k: int = rules.TOP_K
    rerank_cut: int = rules.RERANK_CUT
    max_context_chars: int = rules.CONTEXT_CHARS
    chunk_tokens: int = rules.CHUNK_TOKENS
    chunk_overlap: float = rules.CHUNK_OVERLAP
    max_chunk_bytes: int = rules.MAX_CHUNK_BYTES
    rerank: bool = True
    verify: bool = True

    @classmethod
    def of(cls, values: dict) -> Config:
        known = {f.name: type(f.default) for f in fields(cls)}
        if bad := set(values) - set(known):
            raise ValueError(f"unknown settings: {sorted(bad)}")
        cast = lambda k, v: str(v).lower() in ("1", "true", "yes") if known[k] is bool else known[k](v)
        return cls(**{k: cast(k, v) for k, v in values.items()})

    @classmethod
    def from_file(cls, path: str) -> Config:
        """JSON or, where PyYAML is installed, YAML; settings may stand in groups, the innermost names count."""
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError as e:
                    raise ValueError(f"{path}: reading YAML needs PyYAML") from e
                values = yaml.safe_load(f) or {}
            else:
                values = json.load(f)
        return cls.of(_leaves(values))

    @classmethod
    def from_env(cls, prefix: str = "LEDGERLOOM_") -> Config:
        names = {f.name for f in fields(cls)}
        return cls.of({k[len(prefix) :].lower(): v for k, v in os.environ.items() if k.startswith(prefix) and k[len(prefix) :].lower() in names})
