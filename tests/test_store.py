"""Ingest commits, sinks, reports, dispositions and live places against plain Python."""

import json
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skysift.operators import control, geo, normalize, reports, store
from skysift.plans import catalog, replay
from skysift.sources import bindings, captures, ingest, legacy, sinks

T0 = 1700000000.0


def advertisements(spark, rows):
    return normalize.ble_advertisements(spark.createDataFrame(rows, "mac string, ts double, rssi double"), "s")


def test_ingest_commits_rows_and_watermark_together(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("a", T0 + 10, -1.0), ("b", T0 + 20, -1.0), (None, T0 + 30, -1.0), ("c", T0 + 100, -1.0), ("d", T0 + 5000, -1.0)]
    n = lambda: {"ble": (advertisements(spark, rows), "ts")}
    assert ingest.committed(spark, log) is None
    first = ingest.ingest(spark, log, n(), T0 + 60)
    assert first["watermarks"] == {"ble": T0 + 31} and first["read"] == 3, "a rejected row is consumed"
    # a cycle that died before its commit leaves rows that nobody reads
    advertisements(spark, [("ghost", T0 + 70, 0.0)]).where("reject is null").select(*normalize.COLUMNS).write.parquet(f"{log}/rows/half")
    second = ingest.ingest(spark, log, n(), T0 + 120)
    assert (second["cycle"], second["read"], second["watermarks"]) == (1, 1, {"ble": T0 + 101})
    third = ingest.ingest(spark, log, n(), T0 + 180)
    assert third["read"] == 0 and third["watermarks"] == second["watermarks"]
    assert sorted(r.identity_key for r in ingest.committed(spark, log).collect()) == ["A", "B", "C"]
    late = ingest.ingest(spark, log, n(), T0 + 9000)
    assert late["read"] == 0, "what lies before the catch-up window is not read"


def test_start_of_scan():
    assert ingest.start_of_scan(None, 10_000.0) == 8200.0 and ingest.start_of_scan(9_000.0, 10_000.0) == 9_000.0
    assert ingest.start_of_scan(10_301.0, 10_000.0) == 8200.0 and ingest.start_of_scan(10_300.0, 10_000.0) == 10_300.0 and ingest.start_of_scan(5.0, 100.0) == 5.0


def test_status_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "status")
    for state in ("clear", "alert"):
        sinks.publish_status(spark.createDataFrame([(state,)], "state string"), path)
        assert [r.state for r in spark.read.json(path).collect()] == [state]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["status"]


def test_resolver_tells_a_rollover(spark, tmp_path):
    r = captures.Resolver(spark, str(tmp_path), "*.db")
    with pytest.raises(Exception):
        r.resolve()
    (tmp_path / "a.db").write_text("1")
    assert r.resolve().endswith("a.db") and r.just_rolled
    assert r.resolve().endswith("a.db") and not r.just_rolled
    import os

    (tmp_path / "b.db").write_text("2")
    os.utime(tmp_path / "b.db", (2e9, 2e9))
    assert r.resolve().endswith("b.db") and r.just_rolled


def test_capture_schema(spark):
    good = spark.createDataFrame([], captures.DEVICES)
    assert captures.missing_columns(good) == [] and captures.missing_columns(good.drop("device").withColumn("last_time", F.lit("x"))) == ["device", "last_time"]


def test_dispositions_by_hand(spark):
    day = 86400.0
    rows = [("a", 0.0, "false_positive"), ("a", 1.0, "evidence"), ("a", 2.0, "resolved"), ("a", 3.0, "false_positive"), ("a", 4.0, "known_device"), ("a", 3.0 + 6 * day, "evidence"), ("a", 3.0 + 7 * day, "evidence"), ("a", 4.0 + 7 * day, "evidence"), ("b", 0.0, "evidence")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, subject string, ts double, action string")
    got = [(r.outcome, r.state) for r in control.dispositions(df, "subject").orderBy("subject", "ts", "id").collect()]
    assert got == [("unknown", None), ("opened", "new"), ("invalid", "new"), ("disposed", "false_positive"), ("invalid", "false_positive"), ("noted", "false_positive"), ("reopened", "new"), ("touched", "new"), ("opened", "new")]
    moves = control.timeline(control.dispositions(df, "subject").where("state is not null"), "subject", ["ts", "id"])
    rows_, events = control.applied(moves, "subject", ["ts", "id"])
    assert {r.subject: (r.state, r.severity, r.status, r.closed_at) for r in rows_.collect()} == {"a": ("new", "info", "open", None), "b": ("new", "info", "open", None)}
    assert sorted(r.event_type for r in events.where("subject = 'a'").collect()) == ["incident_closed", "incident_opened", "incident_reopened"]


def test_explained_block(spark):
    rows = [("p", "gps", "copresence", "seen <b> aa:bb:cc:dd:ee:ff", 0.3, False), ("p", "ble", "ble_signal", "tag", 0.25, False), ("p", "gps", "density", "crowd", 0.06, True), ("q", "win", "score", "s", 0.1, False)]
    df = spark.createDataFrame(rows, "subject string, detector string, kind string, detail string, w double, contra boolean")
    df = df.withColumn("confidence", F.when(F.col("subject") == "p", 0.4465).otherwise(0.1)).withColumn("kinds", F.when(F.col("subject") == "p", 2).otherwise(0)).withColumn("may_alert", F.col("subject") == "p")
    got = {r.subject: r.text.split("\n") for r in reports.explained(df, ["subject"]).collect()}
    assert got["p"] == ["Confidence: 45% (2 independent kinds, 2 detector(s))", "Why:", "  + copresence +0.30 — seen b aa:bb:xx:xx:xx:ff (gps)", "  + ble_signal +0.25 — tag (ble)", "Against:", "  - density -0.06 — crowd (gps)"]
    assert got["q"][-1].startswith("Not alertable") and got["q"][1] == "Why:"


def test_place_registry_against_a_loop(spark, data):
    want, anchors = {}, defaultdict(list)
    for r in sorted(bindings.observations(spark, data).collect(), key=lambda r: (r.subject, r.ts, r.id)):
        own = anchors[r.subject]
        hit = next((a for a in own if float(geo.metres(a[0], a[1], r.lat, r.lon)) <= 30.0), None)
        if hit is None:
            hit = [r.lat, r.lon, r.ts]
            own.append(hit)
            if len(own) > 3:
                own.sort(key=lambda a: a[2])
                own.pop(0)
            new = True
        else:
            hit[2], new = r.ts, False
        want[r.id] = (hit[0], hit[1], new)
    got = {r.id: (r.place_lat, r.place_lon, r.is_new) for r in catalog.QUERIES["place_registry"](spark, data).collect()}
    assert got == want and 0 < sum(w[2] for w in want.values()) < len(want)


def test_reports_and_exports(spark, tmp_path):
    a = spark.createDataFrame([(2, 1, 30, "HIGH"), (1, 1, 50, "CRITICAL")], "target int, source int, n int, severity string")
    text = reports.markdown("Attacks", reports.attack_lines(a), 1)
    assert text.split("\n")[2:4] == ["- **CRITICAL** 1 from 1: 50 frames", "- and 1 more"]
    page = reports.html(text + "x < y\n")
    assert "<h1>Attacks</h1>" in page and "<li>and 1 more</li>" in page and "<p>x &lt; y</p>" in page and page.count("<ul>") == page.count("</ul>") == 1
    places = spark.createDataFrame([("a & b", 33.4, -112.0, 50.0, None), ("c", 33.5, -112.0, 50.0, "]]>")], "name string, lat double, lon double, radius double, note string")
    legacy.write_kml(places, str(tmp_path / "kml"), "t")
    from xml.etree import ElementTree

    parts = sorted((tmp_path / "kml").glob("part-*"))
    doc = ElementTree.fromstring("".join(p.read_text() for p in parts))
    assert len(doc.findall(".//{http://www.opengis.net/kml/2.2}Placemark")) == 2
    legacy.export_json(places, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_logs_by_date(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-02-01"):
        (tmp_path / f"cyt_log_{day}.log").write_text(f"line of {day}\n")
    got = legacy.dated_logs(spark, str(tmp_path), "2024-01-02", "2024-01-31").collect()
    assert [r.value for r in got] == ["line of 2024-01-02"]


def test_redaction_at_any_depth(spark):
    obj = {"a": [{"ssid": "home", "x": ["aa:bb:cc:dd:ee:ff <i>"]}], "n": 1, "name": ""}
    df = spark.createDataFrame([(json.dumps(obj),), ("{bad",), (None,)], "j string")
    got = [r.j for r in normalize.redact_json(df, "j").collect()]
    assert got[1:] == [None, None]
    o = json.loads(got[0])
    assert o["a"][0]["x"] == ["aa:bb:xx:xx:xx:ff i"] and o["a"][0]["ssid"].startswith("ssid(len=4,h=") and o["n"] == 1 and o["name"] == "?"


def test_baselines_by_hand(spark):
    acts = ["see", "see", "manual", "see", "forget", "see", "see", "see", "mark_false"]
    df = spark.createDataFrame([(i, float(i), 1, 1, a) for i, a in enumerate(acts)] + [(20 + i, float(i), 1, 2, "see") for i in range(3)] + [(30, 0.0, 1, 3, "see"), (31, 1.0, 1, 3, "forget")], "id long, ts double, place int, subject int, action string")
    got = {r.subject: (r.sightings, r.source, r.first_seen) for r in store.baselines(df, ["place", "subject"], 3).collect()}
    assert got == {1: (3, "mark_false", 5.0), 2: (3, "learned", 0.0)}
    first = store.baselines(df.where("id < 4"), ["place", "subject"], 3).first()
    assert (first.sightings, first.source) == (4, "manual")


def test_sealed_text_differs_each_time(spark):
    from skysift.functions import columns as C

    df = spark.createDataFrame([("x",)], "s string")
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    a, b = (df.select(C.sealed("s", key).alias("x")).first().x for _ in range(2))
    assert a != b and a.startswith("enc:v1:")
    back = spark.createDataFrame([(a,), ("plain",)], "s string").select(C.opened("s", key).alias("k"), C.opened("s", other).alias("o")).collect()
    assert [(x.k, x.o) for x in back] == [("x", None), ("plain", "plain")]


def test_replay_counts_every_keyword(spark, tmp_path):
    rows = [{"source": "kismet.alerts", "row": json.dumps({"ts_sec": T0 + 50 + i, "header": "BSSFLOOD", "json": "{}", "src_mac": "AA", "dst_mac": "BB"})} for i in range(8)]
    doc = {"scenario_version": 1, "scenario_id": "flood", "session_id": "s", "labels": {"kind": "suspicious", "expect": {"detect": True, "state": "watch", "max_latency_cycles": 2}}, "cycles": [{"cycle_id": i, "clock_ts": T0 + 60 * i, "rows": rows if i == 1 else []} for i in range(3)]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    assert list(replay.verdicts(spark, str(tmp_path), []).first().failed) == []


def test_explained_blocks_against_a_loop(spark, data):
    from skysift.operators.incidents import SELF_REFERENCE, WEIGHTS

    kinds = list(WEIGHTS)[:8]
    lines = defaultdict(list)
    for r in bindings.observations(spark, data).collect():
        contra = r.k % 10 == 9
        kind = "density" if contra else kinds[r.k % 8]
        lines[r.subject].append((kind, f"{r.id:012d}", WEIGHTS[kind], contra, r.kind))
    got = {r.subject: r.text for r in catalog.QUERIES["explained_blocks"](spark, data).collect()}
    assert set(got) == set(lines)
    for subject, own in lines.items():
        keep = shrink = 1.0
        for _, _, w, contra, _ in sorted(own):
            keep, shrink = (keep, shrink * (1 - w)) if contra else (keep * (1 - w), shrink)
        confidence = math.floor(max(0.0, min((1 - keep) * shrink, 0.99)) * 1e6 + 0.5) / 1e6
        n = len({k for k, _, _, c, _ in own if not c and k not in SELF_REFERENCE})
        for_, against = ([f"  {m} {k} {s}{w:.2f} — {d} ({det})" for k, d, w, c, det in sorted(own, key=lambda x: (-x[2], x[0], x[1])) if c == side] for m, s, side in (("+", "+", False), ("-", "-", True)))
        text = got[subject].split("\n")
        assert text[0].endswith(f"({n} independent kinds, {len({x[4] for x in own})} detector(s))") and abs(int(text[0].split()[1].rstrip("%")) - confidence * 100) <= 0.5 + 1e-6
        assert text[1:] == (["Why:", *for_] if for_ else ["Why: (no supporting evidence)"]) + (["Against:", *against] if against else []) + ([] if n >= 2 else [text[-1]])


def test_status_report_is_honest_about_age(spark, tmp_path):
    path = str(tmp_path / "status")
    inputs, active = spark.createDataFrame([(1, 0)], "watch_open int, alert_open int"), spark.createDataFrame([("ph:dev:1", "watch")], "incident_key string, lifecycle_state string")
    assert reports.status_report(captures.status_snapshot(spark, path), inputs, active, 100.0)["state"] == "unknown"
    sinks.publish_status(spark.createDataFrame([("watch", 90.0)], "state string, ts double"), path)
    fresh = reports.status_report(captures.status_snapshot(spark, path), inputs, active, 100.0)
    assert (fresh["state"], fresh["counts"]["watch_open"], len(fresh["active"])) == ("watch", 1, 1)
    assert reports.status_report(captures.status_snapshot(spark, path), inputs, active, 241.0)["state"] == "fail"
    sinks.publish_failure(spark, path, 95.0, "no capture")
    assert [(r.state, r.reason) for r in captures.status_snapshot(spark, path).collect()] == [("fail", "no capture")]


def test_fusion_is_attached_or_left_out(spark):
    fields = spark.createDataFrame([("a", '{"kind":"x"}'), ("b", '{"kind":"y"}')], "subject string, evidence_json string")
    blocks = spark.createDataFrame([("a", 0.5)], "subject string, c double").select("subject", F.struct(F.col("c").alias("confidence")).alias("fusion"))
    got = {r.subject: json.loads(r.evidence_json) for r in reports.attach_fusion(fields, blocks, ["subject"]).collect()}
    assert got == {"a": {"kind": "x", "fusion": {"confidence": 0.5}}, "b": {"kind": "y"}}


def test_rendered_text_and_recent_files(spark, tmp_path):
    t = spark.createDataFrame([("shows home net",), ("shows ssid(len=8,h=0000)",)], "text string")
    assert replay.raw_strings(t, "text", ["home net", ""]).count() == 1
    for name in ("a.db", "b.db", "c.txt"):
        (tmp_path / name).write_text("x")
    import os

    os.utime(tmp_path / "a.db", (T0, T0))
    now = max((tmp_path / n).stat().st_mtime for n in ("b.db", "c.txt"))
    assert [r.path.rsplit("/", 1)[1] for r in legacy.newest_files(spark, str(tmp_path), "*.db", now).collect()] == ["b.db"]
