"""Tunable values; the defaults are the reference rules' own."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Weights:
    name_exact: float = 100
    name_core_exact: float = 60
    name_ratio: float = 40
    jurisdiction_exact: float = 25
    country_exact: float = 15
    postcode_exact: float = 35
    postcode_prefix_exact: float = 15
    city_exact: float = 10
    fund_number_exact: float = 20
    registration_id_exact: float = 250


@dataclass(frozen=True)
class Penalties:
    fund_number_conflict: float = 100
    master_conflict: float = 80
    feeder_conflict: float = 80
    registration_id_conflict: float = 250


@dataclass(frozen=True)
class Thresholds:
    auto_match_min_score: float = 140
    auto_match_min_gap: float = 30
    review_min_score: float = 90
    tie_tolerance: float = 5


@dataclass(frozen=True)
class Matching:
    candidate_pool_size: int = 20
    family_pool_size: int = 100
    weights: Weights = field(default_factory=Weights)
    penalties: Penalties = field(default_factory=Penalties)
    decision: Thresholds = field(default_factory=Thresholds)

    def fingerprint(self) -> str:
        """Short hash of all values, kept with each decision."""
        text = json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()[:12]


@dataclass(frozen=True)
class ScaleCheck:
    """When a filing's values look like thousands although they are stated in dollars."""

    min_filers: int = 5
    min_rows: int = 5
    low: float = 0.0005
    high: float = 0.002


@dataclass(frozen=True)
class Serving:
    identifiers_per_type: int = 200
    connections_per_group: int = 25
    top_holdings: int = 10


@dataclass(frozen=True)
class Benchmark:
    min_core_words: int = 3
    max_group: int = 10
    sample_size: int = 5000
    seed: int = 42
