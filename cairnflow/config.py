"""Thresholds of the heuristics, the entity stage and the risk synthesis."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class HeuristicConfig:
    """Per-transaction heuristics. ``unit`` is how many smallest units an amount of 1 has."""

    unit: float = 1e8
    pool_min_equal: int = 3
    pool_min_inputs: int = 3
    pool_min_share: float = 0.35
    dust_units: int = 1000
    dust_min_outputs: int = 8
    dust_min_share: float = 0.5
    round_units: int = 100_000
    change_min_confidence: float = 0.5
    peel_gap_s: int = 12 * 3600
    peel_min_length: int = 4
    peel_max_inputs: int = 2
    hop_dwell_s: int = 1800
    layer_min_length: int = 3
    fan: int = 10
    fan_other: int = 2


@dataclass(frozen=True)
class EntityConfig:
    link_min_confidence: float = 0.6
    rapid_spend_s: int = 1800
    rapid_hop_s: int = 600
    uniform_min_receipts: int = 8
    burst_min_gaps: int = 3


@dataclass(frozen=True)
class RiskConfig:
    """Signal weights, the boost for corroborated signals, the cap of lone anomalies and the tiers."""

    weights: dict[str, float] = field(default_factory=lambda: {"ml": 0.35, "anomaly": 0.25, "graph": 0.20, "correlation": 0.20, "known": 0.40})
    custom_weight: float = 0.20
    custom_weights: dict[str, float] = field(default_factory=dict)
    boost: float = 1.15
    policy_boost: float = 1.10
    lone_anomaly_cap: float = 60.0
    tiers: tuple[tuple[str, float], ...] = (("CRITICAL", 80.0), ("HIGH", 60.0), ("MEDIUM", 40.0))
    lowest: str = "LOW"
    flag_at: float = 40.0
    seed_weight: float = 0.5


@dataclass(frozen=True)
class GraphConfig:
    per_source: int = 50
    per_node: int = 100
    restart: float = 0.15
    walk_steps: int = 40
    max_hops: int = 4
    hub_in: int = 30
    hub_out: int = 8
    hub_addresses: int = 50
    min_events: int = 2


#: The forensic fusion's further signals.
FORENSIC = RiskConfig(custom_weights={"network_obfuscation": 0.15, "temporal_burst": 0.10})


@dataclass(frozen=True)
class ForensicsConfig:
    """The analysis of a dataset: model, folds, seeds and peers."""

    trees: int = 300
    folds: int = 5
    small_folds: int = 2
    small_labels: int = 200
    max_negatives: int = 40_000
    embedding_dims: int = 16
    peer_groups: int = 8
    transfer_tx: int = 8_000
    seed_fraction: float = 0.0
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    """Folders, from the environment: CAIRNFLOW_DATA, CAIRNFLOW_MODELS and CAIRNFLOW_OUT."""

    data: str = "data"
    models: str = "models"
    out: str = "out"

    @classmethod
    def from_env(cls) -> Settings:
        plain = cls()
        return cls(*(os.environ.get(f"CAIRNFLOW_{k.upper()}", getattr(plain, k)) for k in ("data", "models", "out")))
