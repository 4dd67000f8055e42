"""Thresholds of the comparison, by section; a TOML file may replace any of them."""

from __future__ import annotations

import copy
import os
import tomllib

#: Fixed values.
DEFAULT = {
    "load": {"day_types": {"calendar_dates_majority": 0.8, "short_service_max_days": 10, "min_flag_day_ratio": 0.5, "dow_on": 0.6, "dow_stray_max": 0.1, "dow_daily_min_cov": 0.9}},
    "report": {"evidence_sample_max": 20, "file_diff_sample_max": 100, "digest_routes_max": 200, "digest_stops_max": 50},
    "identity": {
        "stop_clustering": {
            "intra_generation_radius_m": 100, "inter_generation_radius_m": 300, "link_floor": 0.25,
            "weight_shared_platform": 0.35, "weight_route_similarity": 0.25, "weight_distance": 0.25, "weight_name_similarity": 0.15,
        },
        "pattern_clustering": {"similarity_threshold": 0.5, "lcs_weight": 0.6, "direction_weight": 0.3, "containment_weight": 0.1, "hierarchical_switch_patterns": 50, "link_floor": 0.3},
        "route_family": {"link_min_similarity": 0.5, "id_bonus": 0.1, "link_floor": 0.3, "stop_link_min": 0.5, "max_component_groups": 6},
        "route_group": {"min_stem_len": 2, "stem_stopwords": ["系統", "線", "循環", "バス"]},
    },
    "matching": {"min_route_sim": 0.5, "max_shift_min": 60, "time_cap_min": 60, "w_route": 1.0, "w_id": 0.05},
    "events": {
        "accept_confidence": 0.5,
        "service_days": {"dates_list_max": 30},
        "windows": {"carryover_coverage_min": 0.8},
        "frequency": {
            "time_bands": ["05:00-07:00", "07:00-09:00", "09:00-16:00", "16:00-19:00", "19:00-22:00", "22:00-29:00"],
            "major_bands": ["07:00-09:00", "16:00-19:00"], "first_last_threshold_min": 15,
        },
        "stops": {"relocated_threshold_m": 300},
        "shape": {"frechet_threshold_m": 150, "max_polyline_points": 200},
        "timetable": {"uniform_shift_max_std_sec": 120},
    },
    "presentation": {
        "system_min_trips": 2, "full_coverage": 0.9, "direction_pair_jaccard": 0.6, "direction_reversed_max_agreement": 0.2, "direction_same_min_agreement": 0.8,
        "direction_min_shared_stops": 3, "hub_min_groups": 3, "sheet_max_gap_per_trip": 1.5, "retime_minor_max_min": 5,
    },
    "diff0": {"bulk_row_threshold": 100_000},
}


def merge(into: dict, more: dict) -> dict:
    for k, v in more.items():
        into[k] = merge(dict(into.get(k, {})), v) if isinstance(v, dict) else v
    return into


def load(path: str | None = None, env: str = "GANTLINE_CONFIG") -> dict:
    """The defaults, with what a file says in place: the argument's, or else that named by an environment variable."""
    path = path or os.environ.get(env)
    out = copy.deepcopy(DEFAULT)
    if path:
        with open(path, "rb") as f:
            merge(out, tomllib.load(f))
    return out
