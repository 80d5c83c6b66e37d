"""Thresholds and weights, grouped by the operators that read them. Pass a changed copy (dataclasses.replace) to an operator."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Layers:
    # What each evidence layer adds to a fused edge, and the layers' thresholds.
    weights: dict[str, float] = field(default_factory=lambda: {"intel": 1.00, "comm": 0.75, "money": 0.80, "co_event": 0.65, "co_place": 0.40})
    structural: tuple[str, ...] = ("intel", "comm", "money")
    strong_co_event: int = 2
    min_calls: int = 2
    money_quantile: float = 0.90
    bucket_people: tuple[int, int] = (2, 8)
    place_start: float = 0.35
    place_step: float = 0.12


@dataclass(frozen=True)
class Resolution:
    # Weights of the evidence, adjustments and bands.
    name: float = 0.34
    phonetic: float = 0.14
    dob: float = 0.16
    geo: float = 0.10
    alias: float = 0.08
    phone: float = 0.10
    neighbours: float = 0.08
    bonus_phone: float = 0.18
    bonus_neighbours: float = 0.14
    penalty_place: float = 0.12
    penalty_dob: float = 0.20
    high: float = 0.82
    medium: float = 0.62
    low: float = 0.45
    max_block: int = 220


@dataclass(frozen=True)
class Anomaly:
    # Thresholds of the detectors.
    thresholds: tuple[int, ...] = (50_000, 1_000_000)
    band: float = 0.12
    structuring_count: int = 5
    structuring_days: int = 30
    layering_quantile: float = 0.90
    layering_hops: int = 3
    layering_accounts: int = 8
    layering_hours: int = 72
    retention: tuple[float, float] = (0.80, 1.02)
    fanout_targets: int = 5
    fanout_hours: int = 6
    fanout_amount: float = 50_000
    fanout_channels: tuple[str, ...] = ("IMPS", "UPI", "NEFT", "WALLET_TRANSFER")
    cash_out_hours: int = 24
    cycle_quantile: float = 0.85
    cycle_hops: tuple[int, int] = (3, 6)
    cycle_tolerance: float = 0.15
    dormant_days: int = 150
    dormant_amount: float = 1_000_000
    dormant_hours: int = 72
    dormant_ratio: float = 0.7
    burst_hours: int = 48
    burst_calls: int = 8
    burst_ratio: float = 3.0
    burst_span_days: int = 2920
    burner_jaccard: float = 0.34
    burner_overlap: float = 0.35


@dataclass(frozen=True)
class KeyPlayer:
    # Weights of the ranks.
    betweenness: float = 0.34
    eigenvector: float = 0.20
    pagerank: float = 0.14
    degree: float = 0.08
    kcore: float = 0.08
    reach: float = 0.16
    command: float = 0.40


# How each relation bears authority. as_is: the source is the subordinate; reverse: the superior.
AUTHORITY = {
    "REPORTS_TO": ("as_is", 1.00), "HANDLER_OF": ("reverse", 0.90), "RECRUITED_BY": ("reverse", 0.70), "ACTS_ON_INSTRUCTIONS_OF": ("as_is", 0.85),
    "FINANCES": ("as_is", 0.45), "SUPPLIES_TO": ("reverse", 0.40), "COMMUNICATION_CONDUIT": ("as_is", 0.50), "BENAMI_OF": ("as_is", 0.75),
}
# Relations that pass authority on.
CHAIN = ("REPORTS_TO", "HANDLER_OF", "RECRUITED_BY", "ACTS_ON_INSTRUCTIONS_OF")
# Confidence of each link mechanism, in the order in which links are merged.
MECHANISMS = {"SHARED_HANDSET_IMEI": 0.92, "SHARED_BANK_ACCOUNT": 0.88, "SHARED_VEHICLE": 0.74, "CO_LOCATION": 0.55, "COMMON_ASSOCIATES": 0.45}
# Incidents of a vehicle, roles of the accused, likeness of a misspelt name.
VEHICLE_INCIDENTS = (2, 8)
ACCUSED_ROLES = ("ACCUSED", "SUSPECT", "ABSCONDING_ACCUSED")
FUZZY_NAME = 0.88
