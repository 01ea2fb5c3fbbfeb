"""Configuration documents."""

import json

import pytest

from skysift import config


def test_defaults_under_a_file(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"timing": {"check_interval": 30}, "fusion": {"weights": {"own": 0.2}}, "baseline": {"places": {"home": {"lat": 1, "lon": 2, "hours": [[0, 8], [20, 24]]}, "work": {"lat": 3, "lon": 4, "radius_m": 30}}}, "rogue_ap_detection": {"monitored_ssids": ["b"], "trusted_aps": [{"ssid": "a"}]}}))
    c = config.load(str(tmp_path / "c.json"))
    assert c["timing"]["check_interval"] == 30 and c["timing"]["list_update_interval"] == 5
    assert c["fusion"]["weights"]["own"] == 0.2 and c["fusion"]["weights"]["copresence"] == 0.30
    assert config.places(c) == [("home", 1.0, 2.0, 100.0, 0, 8), ("home", 1.0, 2.0, 100.0, 20, 24), ("work", 3.0, 4.0, 30.0, 0, 24)]
    assert config.subjects(c) == ["a", "b"] and config.DEFAULTS["timing"]["check_interval"] == 60
    assert config.validated({}) == config.DEFAULTS


def test_all_problems_are_named_at_once():
    bad = {"timing": {"check_interval": 0, "chek": 1}, "push": {"min_severity": "loud", "enabled": 1}, "fusion": {"weights": {"x": 2}}, "status": 5, "zz": 1}
    with pytest.raises(config.ConfigError) as e:
        config.validated(bad)
    text = str(e.value)
    for part in ("timing.check_interval", "timing.chek: unknown", "push.min_severity", "push.enabled", "fusion.weights.x", "status: must be a table", "zz: unknown"):
        assert part in text
    for bad in ({"ie_fingerprint": {"candidate_floor": 0.9}}, {"rogue_ap_detection": {"trusted_aps": [{}]}}, {"gps_fusion": {"merge_radius_m": "x"}}, {"timing": {"check_interval": float("nan")}}):
        with pytest.raises(config.ConfigError):
            config.validated(bad)


def test_merge_leaves_its_arguments():
    a = {"x": {"y": [1]}}
    b = config.merge(a, {"x": {"z": 2}})
    b["x"]["y"].append(9)
    assert a == {"x": {"y": [1]}} and b["x"]["z"] == 2
