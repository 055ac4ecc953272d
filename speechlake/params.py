"""Thresholds of all operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values: the defaults that results must agree with
    min_duration_s: float = 0.5
    max_duration_s: float = 3600.0
    target_duration_s: float = 60.0
    clipping: float = 0.99
    min_speech_s: float = 0.5
    good_snr_db: float = 18.0
    fair_snr_db: float = 10.0
    max_clipping: float = 0.02
    min_bandwidth_hz: float = 3400.0
    min_turn_s: float = 0.4
    merge_gap_s: float = 0.6
    snap_tol_s: float = 0.15
    overlap_warn: float = 0.30
    smooth_conf: float = 0.60
    utterance_gap_s: float = 0.35
    embed_floor_s: float = 1.5
    embed_target_s: float = 8.0
    reliability_good: float = 0.75
    reliability_fair: float = 0.45
    reliability_poor: float = 0.20
    id_threshold: float = 0.55
    id_suggest: float = 0.08
    id_margin: float = 0.04
    id_penalty: float = 0.10
    id_z: float = 1.5
    cluster_threshold: float = 0.52
    cluster_margin: float = 0.04
    cluster_merge: float = 0.62
    auto_reliability: float = 0.75
    auto_match: float = 0.85
    lap_tolerance_s: float = 2.0
    event_floor: float = 0.60
    event_margin: float = 0.05
    event_min_words: int = 6
    event_candidate: float = 0.42
    verdict_batch: int = 10
    verdict_confidence: float = 0.6
    rrf_k: int = 60
    leg_cap: int = 200
    neutral_band: float = 0.20
    most_speakers: int = 5
    smooth_warn: float = 0.05
    language_warn: float = 0.5
    tone_voiced_s: float = 0.15
    tone_calm_least: int = 3
    tone_slow: float = 1.8
    tone_flat: float = 15.0
    tone_fast: float = 3.8
    tone_lively: float = 40.0
    tone_slow_x: float = 0.55
    tone_flat_x: float = 0.6
    tone_fast_x: float = 1.45
    tone_lively_x: float = 1.8


DEFAULTS = Params()
