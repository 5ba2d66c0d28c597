"""Thresholds and weights of retrieval, ranking and decisions, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    trigram_match: float = 0.3
    keep_match: float = 0.30
    match_weight: float = 0.8
    domain_boost: float = 0.2
    category_match: float = 0.12
    category_mismatch: float = -0.35
    expansion_weight: float = 0.8
    # decision gates
    auto_bind: float = 0.92
    auto_bind_medication: float = 0.88
    agreement_floor: float = 0.70
    margin: float = 0.08
    brand_trigram: float = 0.62
    brand_vector: float = 0.30
    brand_margin: float = 0.15
    certainty_wall: float = 0.95
    fallback: float = 0.55
    # multi-signal ranking
    generic_penalty: float = 0.12
    relation_bonus: float = 0.15
    outside_domain: float = -0.10
    close_call: float = 0.05
    soft_gate_floor: float = 0.35
    soft_gate_outside: float = 0.15
    affinity: float = 0.75
    # hybrid catalogue
    cosine_weight: float = 0.65
    bm25_weight: float = 0.35
    barcode_weight: float = 0.35
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    # status tiers
    confirmed: float = 0.90
    drafted: float = 0.60


DEFAULTS = Thresholds()
MEDICATION_KINDS = ["Medication", "Drug", "Preventive", "ParasiteControl"]
