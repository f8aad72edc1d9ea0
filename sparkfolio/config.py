"""All tunables, validated, with a fingerprint that names a configuration."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field

from sparkfolio.operators.chunking import ChunkSettings
from sparkfolio.operators.retrieval import RetrievalSettings

SECRETS = frozenset({"primary_key", "failover_key"})


@dataclass(frozen=True)
class Bands:
    high: float = 0.80
    moderate: float = 0.50

    def __post_init__(self):
        if not self.high > self.moderate:
            raise ValueError("the high band must lie above the moderate one")


@dataclass(frozen=True)
class Settings:
    chunking: ChunkSettings = field(default_factory=ChunkSettings)
    retrieval: RetrievalSettings = field(default_factory=RetrievalSettings)
    bands: Bands = field(default_factory=Bands)
    near_duplicate_threshold: float = 0.97
    hit_rate_k: tuple[int, ...] = (1, 3, 5)
    primary_key: str | None = None
    failover_key: str | None = None

    def __post_init__(self):
        if self.bands.moderate <= self.retrieval.floor:
            raise ValueError("the moderate band must lie above the relevance floor")
        if not self.hit_rate_k or min(self.hit_rate_k) < 1:
            raise ValueError("hit rates need positive ranks")
        for name in SECRETS:
            if (getattr(self, name) or "").strip() == "":
                object.__setattr__(self, name, None)

    def public(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in SECRETS}

    def fingerprint(self) -> str:
        return hashlib.sha256(repr(sorted(self.public().items())).encode()).hexdigest()[:12]

    def providers(self) -> list[str]:
        return [n for n, key in (("primary", self.primary_key), ("failover", self.failover_key)) if key]
