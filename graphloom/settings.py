"""Options of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from .functions import fixed

#: Options that a kind of corpus changes.
PROFILES = {"technical": {"chunk_size": 1200}}


@dataclass(frozen=True)
class Settings:
    chunk_size: int = fixed.CHUNK_SIZE
    chunk_overlap: int = fixed.CHUNK_OVERLAP
    chunk_mode: str = "semantic"
    top_k: int = 10
    min_fidelity: float = 0.3
    max_gaps: int = 15
    repair_iterations: int = 1
    language: str = "en"
    profile: str = ""

    def effective(self) -> Settings:
        return replace(self, **PROFILES.get(self.profile, {}))

    @classmethod
    def from_env(cls, prefix: str = "GRAPHLOOM_") -> Settings:
        """Options from the environment, each under its name in capitals."""
        given = {f.name: type(getattr(cls, f.name))(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**given).effective()
