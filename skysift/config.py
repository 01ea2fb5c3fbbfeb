"""Configuration: defaults under a file's values, every bad value named in one error."""

from __future__ import annotations

import copy
import json
import math
from typing import Any

from skysift.operators.incidents import SELF_REFERENCE, WEIGHTS

#: What holds where a file says nothing.
DEFAULTS: dict[str, Any] = {
    "timing": {"check_interval": 60, "list_update_interval": 5, "time_windows": {"recent": 5, "medium": 10, "old": 15, "oldest": 20}},
    "store": {"retention_days": 14, "heartbeat_keep_days": 7, "entity_retention_days": 30},
    "baseline": {"enabled": False, "min_sightings": 5, "current_place": None, "places": {}},
    "push": {"enabled": False, "min_severity": "alert", "max_attempts": 8, "cooldown_seconds": 300},
    "gps_fusion": {"enabled": True, "cluster_meters": 100, "min_locations_for_cotravel": 2, "min_span_seconds": 900, "incident_score_threshold": 0.55, "merge_radius_m": None, "revisit_gap_s": 600, "max_speed_mps": 35, "cotravel_lookback_s": 21600, "density_window_s": 300},
    "ie_fingerprint": {"enabled": True, "min_probe_ssids": 1, "candidate_floor": 0.30, "link_threshold": 0.70, "relink_alert_floor": 0.95, "min_support": 2, "co_window_s": 30.0, "handoff_max_s": 300.0},
    "ble_tracker": {"enabled": True, "min_score": 0.5},
    "fusion": {"min_independent_kinds": 2, "max_confidence": 0.99, "default_weight": 0.10, "self_ref_kinds": sorted(SELF_REFERENCE), "weights": dict(WEIGHTS)},
    "rf": {"deauth_enabled": True, "rogue_enabled": True},
    "deauth_detection": {"enabled": True, "burst_threshold": 10, "burst_window_seconds": 60, "min_events_for_attack": 5, "attack_window_seconds": 1800, "protected_macs": []},
    "rogue_ap_detection": {"enabled": True, "auto_learn": True, "monitored_ssids": [], "trusted_aps": []},
    "incidents": {"close_after_seconds": 600},
    "status": {"stale_seconds": 150, "hold_seconds": 300, "deaf_seconds": 180, "deaf_is_fail": True, "window_to_severity": {"5-10": "watch", "10-15": "watch", "15-20": "alert"}},
}
#: Closed ranges of numbers by path; all other numbers must be finite and not negative. Names that a value is one of.
RANGES = {
    "timing.check_interval": (1, 3600), "timing.list_update_interval": (1, 1000), "baseline.min_sightings": (1, 10_000), "push.max_attempts": (1, 1000), "gps_fusion.incident_score_threshold": (0, 1), "gps_fusion.min_locations_for_cotravel": (1, 1000),
    "ie_fingerprint.candidate_floor": (0, 1), "ie_fingerprint.link_threshold": (0, 1), "ie_fingerprint.relink_alert_floor": (0, 1), "ble_tracker.min_score": (0, 1), "fusion.min_independent_kinds": (1, 100), "fusion.max_confidence": (0, 1), "fusion.default_weight": (0, 1),
}
CHOICES = {"push.min_severity": ["watch", "alert", "fail", "critical"]}
#: Values that are text or nothing; others without a default are numbers or nothing.
TEXTS = ["baseline.current_place"]
#: Tables whose keys are the file's own.
OPEN = ["baseline.places", "fusion.weights", "status.window_to_severity"]


class ConfigError(ValueError):
    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__(f"invalid configuration ({len(problems)} problem(s)): " + "; ".join(problems))


def merge(base: dict, over: dict) -> dict:
    """base with the values of over; tables are merged key by key, everything else is replaced. Neither argument changes."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def _problems(value: Any, default: Any, path: str) -> list[str]:
    if path in OPEN:
        if not isinstance(value, dict):
            return [f"{path}: must be a table"]
        if path == "fusion.weights":
            return [f"{path}.{k}: must be a number from 0 to 1 (got {v!r})" for k, v in value.items() if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1]
        return []
    if isinstance(default, dict):
        if not isinstance(value, dict):
            return [f"{path}: must be a table"]
        out = [f"{f'{path}.' if path else ''}{k}: unknown key" for k in value if k not in default]
        return out + [p for k in default if k in value for p in _problems(value[k], default[k], f"{path}.{k}" if path else k)]
    if value is None and default is None:
        return []
    if isinstance(default, bool):
        return [] if isinstance(value, bool) else [f"{path}: must be true or false (got {value!r})"]
    if isinstance(default, (int, float)) or default is None and path not in TEXTS:
        lo, hi = RANGES.get(path, (0, math.inf))
        good = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and lo <= value <= hi
        return [] if good else [f"{path}: must be a number from {lo} to {hi} (got {value!r})"]
    if path in CHOICES:
        return [] if value in CHOICES[path] else [f"{path}: must be one of {', '.join(CHOICES[path])} (got {value!r})"]
    kind = type(default) if default is not None else str
    return [] if isinstance(value, kind) else [f"{path}: must be a {kind.__name__} (got {value!r})"]


def validated(config: dict) -> dict:
    """The defaults under config; ConfigError names every problem at once."""
    problems = _problems(config, DEFAULTS, "")
    out = merge(DEFAULTS, config) if not problems else {}
    if out and out["ie_fingerprint"]["candidate_floor"] > out["ie_fingerprint"]["link_threshold"]:
        problems.append("ie_fingerprint.candidate_floor: must not exceed link_threshold")
    if out and out["deauth_detection"]["attack_window_seconds"] < out["deauth_detection"]["burst_window_seconds"]:
        problems.append("deauth_detection.attack_window_seconds: must not be shorter than burst_window_seconds")
    for i, ap in enumerate(out["rogue_ap_detection"]["trusted_aps"] if out else []):
        if not isinstance(ap, dict) or not ap.get("ssid"):
            problems.append(f"rogue_ap_detection.trusted_aps[{i}]: needs an ssid")
    if problems:
        raise ConfigError(problems)
    return out


def load(path: str) -> dict:
    """A JSON file's configuration."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    if not isinstance(doc, dict):
        raise ConfigError(["the document must be a table"])
    return validated(doc)


def places(config: dict) -> list[tuple]:
    """(name, lat, lon, radius, from_hour, to_hour) of each configured place and opening window, in the file's order; a place without windows is open."""
    out = []
    for name, p in config["baseline"]["places"].items():
        for a, b in p.get("hours") or [(0, 24)]:
            out.append((name, float(p["lat"]), float(p["lon"]), float(p.get("radius_m", 100.0)), int(a), int(b)))
    return out


def subjects(config: dict) -> list[str]:
    """The network names that the operator gave: what logs must never show."""
    rogue = config["rogue_ap_detection"]
    return sorted({*rogue["monitored_ssids"], *(ap["ssid"] for ap in rogue["trusted_aps"])})
