"""Boundary cases and known outcomes of the operators."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skysift.functions import columns as C
from skysift.operators import geo, identity, incidents, legacy_stats, normalize, pairs, radio, windows
from skysift.plans import catalog
from skysift.sources import bindings

DEAUTH = ("deauth", [("deauth_pattern", "a", 0.35, False), ("attack_signature", "b", 0.20, False), ("source_severity", "c", 0.15, False)])
TRAVEL = ("cotravel", [("copresence", "a", 0.30, False), ("travel_span", "b", 0.25, False), ("score", "c", 0.10, False)])
MATCH = ("windows", [("mac_reappear", "w", 0.10, False)])


@pytest.mark.parametrize(
    ("rows", "state", "confidence"),
    [
        ([DEAUTH], "WATCH", 0.558), ([MATCH], "NEW", 0.10), ([("windows", [("mac_reappear", str(i), 0.10, False) for i in range(3)])], "NEW", 0.271),
        ([("rogue", [("rogue_reason", "a", 0.25, False)])], "NEW", 0.25), ([("rogue", [("rogue_reason", x, 0.25, False) for x in "ab"])], "WATCH", 0.4375),
        ([("ble", [("ble_signal", x, 0.25, False) for x in "ab"] + [("score", "s", 0.10, False)])], "WATCH", 0.49375),
        ([TRAVEL], "WATCH", 0.5275), ([TRAVEL, DEAUTH], "ALERT", 0.791155), ([TRAVEL, DEAUTH, ("density", [("density", "d", 0.06, True)])], "ALERT", 0.743686),
        ([("cotravel", TRAVEL[1] + [("density", "d1", 0.06, True), ("density", "d2", 0.06, True)])], "WATCH", 0.466099),
    ],
)
def test_known_outcomes(rows, state, confidence):
    m = incidents.Lifecycle()
    m.evidence(1000.0, rows)
    assert (m.state, m.confidence) == (state, pytest.approx(confidence, abs=2e-6))


def test_three_matches_in_rows_observe():
    m = incidents.Lifecycle()
    m.evidence(0.0, [("a", MATCH[1]), ("b", MATCH[1]), ("c", MATCH[1])])
    assert m.state == "OBSERVING"


def test_decay_resolve_and_reopen():
    m = incidents.Lifecycle()
    m.evidence(0.0, [TRAVEL, DEAUTH])
    m.silent(120.0)
    assert m.state == "ALERT"
    m.silent(180.0)
    m.silent(240.0)
    assert m.state == "OBSERVING"
    m.silent(601.0)
    assert m.state == "RESOLVED"
    m.evidence(660.0, [MATCH])
    assert m.state == "NEW"
    m.silent(5000.0)
    assert m.state == "NEW"


def test_fusion_is_monotone_and_order_free(spark):
    rng = random.Random(3)
    rows = [(s, k, str(i), False) for s in range(30) for i, k in enumerate(rng.choices(list(incidents.WEIGHTS)[:8], k=rng.randint(1, 6)))]
    df = incidents.weigh(spark.createDataFrame(rows, "s int, kind string, detail string, contra boolean"))
    one = {r.s: r.confidence for r in incidents.fuse_by(df, ["s"]).collect()}
    two = {r.s: r.confidence for r in incidents.fuse_by(df.orderBy(F.rand(5)).repartition(3), ["s"]).collect()}
    more = {r.s: r.confidence for r in incidents.fuse_by(df.unionByName(df.select("s", F.lit("rogue_reason").alias("kind"), F.lit("z").alias("detail"), "contra", F.lit(0.25).alias("w"))), ["s"]).collect()}
    assert one == two and all(more[s] >= one[s] for s in one)


def point(m):
    return 33.4 + m / 111194.9


def test_leader_clusters_and_visits(spark):
    rows = [(1, 0.0, point(0), -112.0), (1, 10.0, point(29), -112.0), (1, 20.0, point(31), -112.0), (1, 900.0, point(0), -112.0), (1, 1501.0, point(1), -112.0), (2, 5.0, point(0), -112.0)]
    df = geo.assign_clusters(spark.createDataFrame(rows, "subject long, ts double, lat double, lon double"))
    assert [r.cluster for r in df.where("subject = 1").orderBy("ts").collect()] == [0, 0, 1, 0, 0]
    v = geo.visits(df).where("subject = 1").orderBy("visit").collect()
    assert [(x.cluster, x.enter_ts, x.exit_ts) for x in v] == [(0, 0.0, 10.0), (1, 20.0, 20.0), (0, 900.0, 900.0), (0, 1501.0, None)]
    again = geo.visits(geo.assign_clusters(spark.createDataFrame(random.Random(1).sample(rows, 6), df.select("subject", "ts", "lat", "lon").schema).repartition(5)))
    assert again.where("subject = 1").count() == 4


def test_infeasible_jump_is_dropped(spark):
    rows = [(1, 1, 0.0, 100.0, 33.4, -112.0), (1, 2, 700.0, 800.0, 37.0, -112.0), (1, 3, 900.0, None, 33.41, -112.0)]
    v = spark.createDataFrame(rows, "subject long, visit long, enter_ts double, exit_ts double, lat double, lon double")
    assert [r.visit for r in geo.feasible_visits(v).orderBy("visit").collect()] == [1, 3]


def test_feasible_visits_against_a_loop(spark, data):
    from skysift.plans import catalog

    v = catalog._visits(spark, data)
    rows = sorted(v.collect(), key=lambda r: (r.subject, r.enter_ts, r.visit))
    kept, prev = [], None
    for r in rows:
        if prev is None or prev.subject != r.subject or float(geo.metres(prev.lat, prev.lon, r.lat, r.lon)) <= 0.05 * max(r.enter_ts - (prev.enter_ts if prev.exit_ts is None else prev.exit_ts), 0) + 60:
            kept.append((r.subject, r.visit))
            prev = r
    assert sorted((r.subject, r.visit) for r in geo.feasible_visits(v, 0.05, 30.0).collect()) == sorted(kept)


def test_cotravel_needs_place_and_time(spark):
    s = "subject long, visit long, cluster int, enter_ts double, exit_ts double, lat double, lon double, n long"
    op = spark.createDataFrame([(0, 1, 0, 0.0, 100.0, 33.4, -112.0, 1), (0, 2, 1, 1000.0, None, 33.42, -112.0, 1)], s)
    en = spark.createDataFrame([(5, 1, 0, 50.0, 60.0, point(59), -112.0, 1), (5, 2, 1, 1599.0, None, 33.42, -112.0, 1), (6, 1, 0, 200.0, 300.0, 33.4, -112.0, 1), (7, 1, 0, 50.0, 60.0, point(61), -112.0, 1)], s)
    assert sorted((r.subject, r.visit) for r in geo.cotravel(en, op).collect()) == [(5, 1), (5, 2)]


def test_link_rules(spark):
    s = "key string, ssids array<string>, tags array<int>, first_ts double, last_ts double, n long"
    v = spark.createDataFrame(
        [("a", ["x", "y", "z"], [1, 2], 0.0, 100.0, 5), ("b", ["x", "y", "z"], [1, 2], 200.0, 300.0, 5), ("c", ["x", "y", "z"], [1, 2], 129.0, 260.0, 5), ("d", ["x"], [9], 5000.0, 5100.0, 1)], s
    )
    got = {(r.key_a, r.key_b): (r.status, r.confidence) for r in identity.link_scores(v, identity.candidate_pairs(v)).collect()}
    assert got["a", "b"][0] == "linked" and got["a", "b"][1] == pytest.approx(0.45 + 0.12 + 0.25 + 0.075 + 0.05, abs=1e-6)
    assert got["a", "c"] == ("rejected", 0.0) and got["b", "c"] == ("rejected", 0.0)
    assert ("a", "d") not in got


def test_link_score_with_places(spark):
    """Half of a's places lie at b's one, and all of b's at a's: 0.10 * 0.75 more than without places."""
    rows = [("a", "x", 1, 0.0, 33.4, -112.0), ("a", "x", 1, 100.0, 33.5, -112.0), ("b", "x", 1, 5000.0, 33.4003, -112.0), ("b", "x", 1, 5100.0, None, -112.0), ("c", "x", 1, 9000.0, None, None)]
    o = spark.createDataFrame(rows, "key string, ssid string, tag int, ts double, lat double, lon double")
    got = []
    for located in (False, True):
        v = identity.views(o, "key", "ssid", "tag", located)
        got.append({(r.key_a, r.key_b): r.confidence for r in identity.link_scores(v, identity.candidate_pairs(v)).collect()})
    assert got[1] == pytest.approx({**got[0], ("a", "b"): got[0]["a", "b"] + 0.075}, abs=1e-6)


def test_trusted_radio_with_changed_traits(spark):
    trusted = spark.createDataFrame([("n", b, "WPA2-PSK", 6) for b in range(5)], "ssid string, bssid long, encryption string, channel int")
    seen = [("n", 0, "WPA2", 6), ("n", 0, None, None), ("n", 1, "WPA2-PSK", 6), ("n", 1, "OPEN", 6), ("n", 2, "WPA2-PSK", 11), ("n", 3, "", 0), ("n", 9, "WPA2-PSK", 6), ("m", 1, "OPEN", 1)]
    s = spark.createDataFrame(seen, "ssid string, bssid long, encryption string, channel int")
    want = {0: (2, "trusted"), 1: (2, "MEDIUM"), 2: (1, "MEDIUM"), 3: (1, "trusted"), 9: (1, "CRITICAL")}
    assert {r.bssid: (r.n, r.verdict) for r in radio.trusted_check(s, trusted).collect()} == want
    assert {r.bssid: r.verdict for r in radio.trusted_check(s, trusted.select("ssid", "bssid")).collect()} == {b: "CRITICAL" if b == 9 else "trusted" for b in want}


def test_hypothesis_rejection_sticks(spark):
    f = spark.createDataFrame([("a", "b", 1, 0.9, "linked"), ("a", "b", 2, 0.0, "rejected"), ("a", "b", 3, 0.95, "linked"), ("c", "d", 1, 0.5, "candidate"), ("c", "d", 2, 0.5, "linked"), ("c", "d", 3, 0.4, "candidate")], "key_a string, key_b string, seq long, confidence double, status string")
    got = {r.key_a: (r.confidence, r.status) for r in identity.merge_hypotheses(f).collect()}
    assert got == {"a": (0.0, "rejected"), "c": (0.5, "linked")}


def test_peak_rate_is_closed(spark):
    df = spark.createDataFrame([(1, 1, t, 6) for t in (0.0, 30.0, 60.0, 60.5)] + [(2, 1, 5.0, 6)], "target int, source int, ts double, channel int")
    got = {r.target: (r.n, r.rate) for r in radio.peak_rates(df).collect()}
    assert got == {1: (4, 3.0), 2: (1, 1.0)}


def test_reappearance_labels(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 410.0), (1, 910.0), (2, 10.0), (2, 1600.0)], "subject long, ts double")
    assert {(r.subject, r.label, r.severity) for r in windows.reappearances(df, 300.0).collect()} == {(1, "5-10", "watch"), (1, "10-15", "watch"), (1, "15-20", "alert")}


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (lambda: C.normalize_mac("x"), " aa:bb:cc:dd:ee:ff/24 ", "AA:BB:CC:DD:EE:FF"), (lambda: C.normalize_mac("x"), " /x", None),
        (lambda: C.mask_macs("x"), "saw aa:bb:cc:dd:ee:ff.", "saw aa:bb:xx:xx:xx:ff."), (lambda: C.neutral_text("x"), "<b>‮hi\x00 [x]`", "b hi x"),
        (lambda: C.subject_token("x"), "", "?"), (lambda: C.replace_subjects("x", ["net", "netgear"]).contains("net"), "my netgear", False),
        (lambda: C.escape_markdown("x"), "a\\*[b]", "a\\\\*\\[b\\]"), (lambda: C.escape_xml("x"), "<&>", "&lt;&amp;&gt;"), (lambda: C.finite("x"), "nan", None), (lambda: C.finite("x"), "2.5", 2.5),
        (lambda: C.is_downgrade(F.lit("WPA2-PSK"), "x"), "wpa", True), (lambda: C.encryption_matches(F.lit("WPA2"), "x"), "wpa2-psk", True), (lambda: C.channel_of(F.col("x").cast("int")), "5825000", 165),
        (lambda: C.channel_of(F.col("x").cast("int")), "2437000", 6), (lambda: C.channel_of(F.col("x").cast("int")), "2437", None), (lambda: C.tracker_score("x", F.lit("{}"), F.lit(True)), "My AirTag", 0.8),
    ],
)
def test_scalars(spark, column, value, want):
    got = spark.createDataFrame([Row(x=value)]).select(column().alias("y")).first().y
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_sql_functions(spark):
    C.register_sql(spark)
    r = spark.sql("SELECT sky_haversine(33.4, -112.0, 33.41, -112.0) AS d, sky_mac('aa/x') AS m, sky_token('net') AS t").first()
    assert math.isclose(r.d, 1111.95, abs_tol=0.1) and r.m == "AA" and r.t.startswith("ssid(len=3,h=")


def test_normalizers(spark):
    dev = {"kismet.device.base.location": {"kismet.common.location.geopoint": [-112.0, 33.4], "kismet.common.location.time_sec": 5}, "kismet.device.base.signal": {"kismet.common.signal.last_signal": -40},
           "dot11.device": {"dot11.device.advertised_ssid_map": [{"dot11.advertisedssid.ssid": "cafe", "dot11.advertisedssid.crypt_string": "WPA2"}], "dot11.ie_tag_list": [1, 3, 3]}}
    d = spark.createDataFrame([("aa:bb:cc:dd:ee:ff/x", "Wi-Fi AP", json.dumps(dev), 10.0), (None, "Wi-Fi AP", "{bad", 10.0), ("aa", None, None, float("nan")), ("BB", "BTLE Device", "{bad", 3.0)], "devmac string, type string, device string, last_time double")
    good, bad = normalize.split_rejects(normalize.devices(d, "s", 99.0))
    got = {r.identity_key: r for r in good.collect()}
    assert set(got) == {"AA:BB:CC:DD:EE:FF", "BB"} and sorted(r.reject for r in bad.collect()) == ["no identity", "no time"]
    assert (got["AA:BB:CC:DD:EE:FF"].lat, got["AA:BB:CC:DD:EE:FF"].lon) == (33.4, -112.0) and json.loads(got["AA:BB:CC:DD:EE:FF"].payload_json)["rssi"] == -40
    assert got["BB"].kind == "ble_adv" and got["BB"].lat is None
    f = {r.devmac: r for r in normalize.features(d.select("devmac", "device")).collect()}
    assert f["aa:bb:cc:dd:ee:ff/x"].ie_tags == [1, 3] and f["aa:bb:cc:dd:ee:ff/x"].ssids == ["cafe"] and f["BB"].digest is None
    assert [(r.ssid, r.encryption) for r in normalize.ap_sightings(d).collect()] == [("cafe", "WPA2")]
    a = spark.createDataFrame([(5.0, "DEAUTHFLOOD", "{}", "aa", None, None), (6.0, "X", '{"kismet.alert.text": "many disassoc frames", "kismet.alert.source_mac": "cc"}', None, None, None), (7.0, "X", None, None, None, None)], "ts_sec double, header string, json string, src_mac string, dst_mac string, bssid string")
    assert [(r.kind, r.identity_key, r.reject) for r in normalize.alerts(a, "s").collect()] == [("deauth_alert", "AA", None), ("deauth_alert", "CC", None), ("kismet_alert", None, "no identity")]
    g = spark.createDataFrame([(33.4, -112.0, 5.0, 3.0), (99.0, 0.0, 5.0, None), (1.0, 1.0, None, None)], "lat double, lon double, ts double, accuracy_m double")
    assert [r.reject for r in normalize.gps_fixes(g, "s").collect()] == [None, "no place", "no time"]


def test_queries_read_whole_tables(spark, data):
    """No filter by id, no prefix of subjects: rows of the queries against plain counts over all observations."""
    text = " ".join(catalog.ORACLES.values())
    assert not any(f"id % {n}" in text and f"id % {n} =" in text and "WHERE id %" in text for n in (5, 7, 9)) and "subject < 20" not in text and "subject < 4 " not in text
    o = bindings.observations(spark, data).collect()
    assert sum(r.n for r in catalog.QUERIES["weight_assignment"](spark, data).collect()) == len(o)
    assert catalog.QUERIES["stable_place_id"](spark, data).count() == len({(r.k, r.lat, r.lon) for r in o})
    assert {r.id for r in catalog.QUERIES["scenario_export_cycles"](spark, data).collect()} == {r.id for r in o}
    seen = {}
    for r in o:
        seen.setdefault(r.subject, set()).add(r.k)
    want = {(a, b, len(seen[a] & seen[b])) for a in seen for b in seen if a < b and len(seen[a] & seen[b]) >= 5}
    assert {(r.key_a, r.key_b, r.shared) for r in catalog.QUERIES["fingerprint_pairs"](spark, data).collect()} == want


def test_thinning_against_a_loop(spark, data):
    rows = sorted(map(tuple, bindings.observations(spark, data).select("subject", "ts", "id", "lat", "lon").collect()))
    want, last = [], {}
    for subject, _, i, lat, lon in rows:
        if subject not in last or math.hypot(lat - last[subject][0], lon - last[subject][1]) * 111000 >= 5000:
            last[subject] = lat, lon
            want.append((i, subject))
    assert sorted(map(tuple, catalog.QUERIES["gps_thin"](spark, data).collect())) == sorted(want)


def test_cooldown_counts_from_the_last_message_sent(spark):
    """Events every 0.9 cooldowns: every second one goes out, not only the first."""
    df = spark.createDataFrame([("a", i, 90.0 * i) for i in range(6)] + [("b", 9, 10.0)], "key string, id long, ts double")
    assert sorted((r.key, r.id) for r in windows.cooled(df, ["key"], "ts", 100.0, ["ts", "id"]).collect()) == [("a", 0), ("a", 2), ("a", 4), ("b", 9)]


def test_density_counts_none_and_crosses_the_antimeridian(spark):
    v = spark.createDataFrame([(1, 1, 1000.0, None, 10.0, 179.99999), (2, 1, 1000.0, 90000.0, 89.9999, 0.0), (3, 1, 5.0, 6.0, 0.0, 0.0)], "subject long, visit long, enter_ts double, exit_ts double, lat double, lon double")
    s = spark.createDataFrame([(7, 1100.0, 10.0, -179.99999), (8, 1100.0, 10.0, 179.9), (0, 1000.0, 10.0, 179.99999), (1, 1000.0, 10.0, 179.99999), (9, 80000.0, 89.9999, 180.0), (9, 80001.0, 89.9999, 170.0), (7, 99999.0, 0.0, 0.0)], "subject long, ts double, lat double, lon double")
    got = {r.subject: r.others for r in geo.density(v, s, 0).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_cells_hold_all_neighbours(spark):
    """Points at the radius in every direction lie in one of the cells, at any latitude."""
    rng = random.Random(4)
    rows = [(i, rng.choice([rng.uniform(-89.9999, 89.9999), rng.uniform(-1, 1), 89.9995, -89.9999]), rng.choice([rng.uniform(-180, 180), 179.9999, -180.0])) for i in range(200)]
    near = []
    for i, lat, lon in rows:
        for k in range(8):
            d, t = 49.9 / 6371000.0, k * math.pi / 4
            la = math.radians(lat)
            y = math.asin(max(-1, min(1, math.sin(la) * math.cos(d) + math.cos(la) * math.sin(d) * math.cos(t))))
            x = math.radians(lon) + math.atan2(math.sin(t) * math.sin(d) * math.cos(la), math.cos(d) - math.sin(la) * math.sin(y))
            near.append((i, math.degrees(y), (math.degrees(x) + 540) % 360 - 180))
    a = spark.createDataFrame(rows, "i long, lat double, lon double").select("i", geo.cells_near("lat", "lon", 50.0).alias("cells"))
    b = spark.createDataFrame(near, "i long, lat double, lon double").select("i", geo.cell("lat", "lon").alias("c"))
    assert b.join(a, "i").where(~F.array_contains("cells", F.col("c"))).count() == 0


def test_spatial_signal_needs_places(spark):
    rows = [("a", "x", 1, 0.0, 33.4, -112.0), ("a", "x", 1, 100.0, 33.5, -112.0), ("b", "x", 1, 5000.0, 33.4003, -112.0), ("c", "x", 1, 9000.0, None, None)]
    o = spark.createDataFrame(rows, "key string, ssid string, tag int, ts double, lat double, lon double")
    v = {r.key: r for r in identity.views(o, "key", "ssid", "tag", True).collect()}
    assert {k: (len(r.places), len(r.reached)) for k, r in v.items()} == {"a": (2, 3), "b": (1, 2), "c": (0, 0)}


def test_entity_meta_is_the_newest_that_is_not_null(spark):
    from skysift.operators import upserts

    df = spark.createDataFrame([("a", 1, 5.0, "x"), ("a", 2, 4.0, "y"), ("a", 3, 9.0, None)], "key string, id long, ts double, meta string")
    r = upserts.entities(df, ["key"]).first()
    assert (r.first_seen, r.last_seen, r.see_count, r.meta) == (4.0, 9.0, 3, "y")


def test_keywords():
    assert {"bssflood", "apspoof", "changehostname"} <= set(C.DEAUTH_KEYWORDS)


def test_transitions_outside_the_days(spark):
    """Incidents after the clock, or over before the thirty days, overlap none of them; one that spans all overlaps each."""
    now, day = catalog.NOW, catalog.DAY
    rows = [(now + 60.0, now + 3600.0), (now, now + 1.0), (now - 32 * day, now - 30.5 * day), (now - 40 * day, now - 30 * day - 1), (now - 40 * day, now + day), (now - 30 * day, now - 30 * day)]
    got = {r.day: (r.opened, r.closed, r.overlapping) for r in catalog._transitions(spark, spark.createDataFrame(rows, "first_ts double, last_ts double")).collect()}
    bounds = {d: (now - (d + 1) * day, now - d * day) for d in range(30)}
    assert got == {d: (sum(lo <= a < hi for a, _ in rows), sum(lo <= b < hi for _, b in rows), sum(a < hi and b >= lo for a, b in rows)) for d, (lo, hi) in bounds.items()}


def test_blocks_of_pairs_agree_with_joins(spark, monkeypatch):
    """Common names: blocks in place of the join, over several blocks, the same pairs and scores."""
    rng = random.Random(7)
    rows = [(f"k{i % 40}", f"n{rng.randrange(12)}", rng.randrange(4), rng.choice([0, 3000, 4000]) + 40.0 * i % 97, 33.4 + 0.0003 * rng.randrange(6), -112.0) for i in range(600)]
    rows += [("alone", None, None, 1e6, None, None), (None, "n1", 1, 5.0, 33.4, -112.0)]
    o = spark.createDataFrame(rows, "key string, ssid string, tag int, ts double, lat double, lon double")
    monkeypatch.setattr(identity.blocks, "LEAST", 8)
    for located in (False, True):
        v = identity.views(o, "key", "ssid", "tag", located).where("key is not null")
        assert identity._crowded(v, "ssids")
        assert sorted(identity.links(v).collect()) == sorted(identity.link_scores(v, identity._joined_pairs(v, "ssids")).collect()) != []
    want = sorted(identity._joined_pairs(v, "ssids").collect())
    assert sorted(identity.candidate_pairs(v).collect()) == want
    sizes = {r.key: len(r.ssids) for r in v.collect()}
    assert sorted(identity.shared_counts(v).collect()) == [(*r, sizes[r.key_a] + sizes[r.key_b]) for r in want]
    c = o.withColumn("fingerprint", F.col("tag")).select("key", "ssid", "fingerprint", "ts")
    got = [sorted(identity.cycle_pairs(c.where("ts < 3500"), c).collect())]
    monkeypatch.setattr(identity.blocks, "crowded", lambda *a: False)
    assert got == [sorted(identity.cycle_pairs(c.where("ts < 3500"), c).collect())] != [[]]
    assert not any(x in identity.candidate_pairs(v)._jdf.queryExecution().executedPlan().toString() for x in ("MapInArrow",))


def test_density_tells_only_repeated_subjects_apart(spark):
    """Against plain counts, with subjects seen once and several times around a visit; what the last exchange takes is near the number of visits."""
    rng = random.Random(3)
    v = [(i, j, t, rng.choice([None, t + 900.0]), 33.4 + 0.0002 * rng.randrange(3), -112.0) for i in range(4) for j, t in ((1, 1000.0), (2, 9000.0))]
    s = [(rng.randrange(60), rng.randrange(110) * 100.0, 33.4 + 0.0002 * rng.randrange(3), -112.0 + 0.0001 * rng.randrange(2)) for _ in range(400)]
    out = geo.density(spark.createDataFrame(v, "subject long, visit long, enter_ts double, exit_ts double, lat double, lon double"), spark.createDataFrame(s, "subject long, ts double, lat double, lon double"), 0)
    want = {(a, b): len({o for o, ts, p, q in s if o not in (0, a) and t - 300 <= ts <= (e or t) + 300 and float(geo.metres(lat, lon, p, q)) <= geo.MERGE_M}) for a, b, t, e, lat, lon in v}
    assert {(r.subject, r.visit): r.others for r in out.collect()} == want and max(want.values()) > 5
    assert "_one" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("held", [1 << 21, 40])
def test_meetings_are_counted_without_a_join_of_sightings(spark, monkeypatch, held):
    """More blocks than one; ties, times just so far apart, nulls, times that are not finite, and a subject with more meetings than are held at a time."""
    monkeypatch.setattr(pairs, "LEAST_ROWS", 64)
    rng = random.Random(11)
    rows = [(rng.choice(["hub", "hub", *"abcdefghij", None]), rng.choice([0.0, 0.5, 1.0, 1e9 + 0.1, rng.uniform(0, 20)]), rng.choice([1, 2, 3, None])) for _ in range(400)]
    rows += [("a", float("nan"), 1), ("b", float("inf"), 1), ("a", None, 1)]
    expected = Counter()
    for s, t, k in rows:
        for o, u, m in rows:
            if s is not None and o is not None and k is not None and k == m and s < o and t is not None and u is not None and abs(t - u) < 0.5:
                expected[s, o] += 1
    a = spark.createDataFrame(rows, "subject string, ts double, place int")
    want = {p: n for p, n in expected.items() if n >= 2}
    got = pairs.meetings(a.select(F.col("subject").alias("key"), "place", "ts"), 0.5, 2, held)
    assert {(r.key_a, r.key_b): r.n for r in got.collect()} == want
    got = legacy_stats.correlations(a, "place", 0.5, 2)
    assert {(r.subject, r.other): r.together for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().toString()


def _shuffled_rows(spark, df) -> tuple[list, int]:
    """The rows of df, not collected before, and how many rows that writes to shuffles."""
    sc = spark.sparkContext
    group = f"shuffled-{id(df)}"
    sc.setJobGroup(group, group)
    rows = df.collect()
    sc.setJobGroup("other", "other")
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return rows, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_blocks_are_not_copied_for_each_other_block(spark, monkeypatch):
    """Each key and each packed block is shuffled once, however many blocks there are; keys of several kinds, the same pairs."""
    monkeypatch.setattr(pairs, "LEAST", 8)
    rows = [(i, [j for j in range(9) if (i >> j % 6) + j & 1]) for i in range(64)]
    want = {(a, b, len({*x} & {*y})) for a, x in rows for b, y in rows if a < b and {*x} & {*y}}
    assert len(want) > 1000
    for kind in ("long", "int", "string"):
        v = spark.createDataFrame(rows, "key long, ssids array<int>").withColumn("key", (F.col("key") + 10).cast(kind))
        got, moved = _shuffled_rows(spark, pairs.compared(v, identity._counted("ssids"), "shared bigint"))
        assert {(int(r.key_a) - 10, int(r.key_b) - 10, r.shared) for r in got} == want
        assert 64 < moved <= 64 + 8


def test_sightings_are_shuffled_once(spark, monkeypatch):
    """Only packed blocks are copied for each other block; the same meetings."""
    monkeypatch.setattr(pairs, "LEAST_ROWS", 64)
    rows = [(i % 37, float(i % 50), i % 3) for i in range(512)]
    want = Counter((s, o) for s, t, k in rows for o, u, m in rows if s < o and k == m and abs(t - u) < 1.5)
    got, moved = _shuffled_rows(spark, pairs.meetings(spark.createDataFrame(rows, "key long, ts double, place int"), 1.5))
    assert {(r.key_a, r.key_b): r.n for r in got} == want
    assert 512 < moved <= 512 + 8 * 8 + 8


@pytest.mark.parametrize("how", ["shared_counts", "candidate_pairs"])
def test_common_names_move_each_subject_once(spark, monkeypatch, how):
    """Through the operators of ssid_jaccard and of fingerprint_pairs; the same pairs as by the join on names."""
    monkeypatch.setattr(pairs, "LEAST", 8)
    v = spark.createDataFrame([(i, [j for j in range(9) if (i >> j % 6) + j & 1]) for i in range(64)], "key long, ssids array<int>")
    got, moved = _shuffled_rows(spark, getattr(identity, how)(v))
    assert 64 < moved <= 64 + 8
    monkeypatch.setattr(identity.blocks, "crowded", lambda *a: False)
    assert sorted(got) == sorted(getattr(identity, how)(v).collect()) and len(got) > 1000


def test_a_cycle_of_common_names_moves_each_subject_once(spark, monkeypatch):
    """Eight blocks shuffle a row more for each of seven blocks than one does, not eight times the subjects; the same pairs."""
    c = spark.createDataFrame([(i, j, j % 3, float(i)) for i in range(64) for j in range(9) if (i >> j % 6) + j & 1], "key long, ssid int, fingerprint int, ts double")
    got = {}
    for least in (64, 8):
        monkeypatch.setattr(pairs, "LEAST", least)
        got[least] = _shuffled_rows(spark, identity.cycle_pairs(c.where("ts < 50"), c))
    assert got[8][1] - got[64][1] <= 7
    assert sorted(got[8][0]) == sorted(got[64][0]) and len(got[8][0]) > 1000
