"""Settings of the pipeline, read from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from scriptorium.operators.chunking import CHUNK_OVERLAP, CHUNK_TARGET, WINDOW_OVERLAP, WINDOW_TARGET
from scriptorium.operators.resolution import COSINE
from scriptorium.operators.retrieval import TOP_K

PREFIX = "SCRIPTORIUM_"


@dataclass(frozen=True)
class Settings:
    """Sizes and thresholds; every field can be set by an environment variable of its name after PREFIX."""

    chunk_tokens: int = CHUNK_TARGET
    chunk_overlap: int = CHUNK_OVERLAP
    window_tokens: int = WINDOW_TARGET
    window_overlap: int = WINDOW_OVERLAP
    top_k: int = TOP_K
    resolver_threshold: float = COSINE
    row_limit: int = 200
    backend: str = "rule"
    work: str = "work"
    budget: float = 0.0
    calls_a_second: float = 0.0

    def __post_init__(self) -> None:
        if not (0 <= self.chunk_overlap < self.chunk_tokens and 0 <= self.window_overlap < self.window_tokens):
            raise ValueError("an overlap is smaller than its size")
        if not 1 <= self.top_k <= 50 or not 0 < self.resolver_threshold <= 1 or self.row_limit < 1:
            raise ValueError("top_k is 1 to 50, resolver_threshold above 0 up to 1, row_limit at least 1")
        object.__setattr__(self, "work", os.path.abspath(self.work) if "://" not in self.work else self.work)


def get_settings(environment: dict[str, str] | None = None) -> Settings:
    """The settings of an environment (by default the process's)."""
    said = os.environ if environment is None else environment
    kinds = {"int": int, "float": float, "str": str}
    return Settings(**{f.name: kinds[str(f.type)](said[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in said})
