"""Readers, writers, streams and replay."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from skysift.operators import incidents, normalize, windows
from skysift.plans import replay
from skysift.sources import captures, sinks
from skysift.streaming import live

T0 = 1700000000.0


def scenario(name, kind, cycles, detect, latency=None, keys=None, final=None, **more):
    return {
        **more,
        "scenario_version": 1, "scenario_id": name, "session_id": "s", "description": "", "labels": {"kind": kind, "expect": {"detect": detect, "state": final or ("watch" if detect else "clear"), "max_latency_cycles": latency, "entity_keys": keys}},
        "cycles": [{"cycle_id": i, "clock_ts": T0 + 60 * i, "rows": rows} for i, rows in enumerate(cycles)],
    }


def alert(ts, src="AA:AA:AA:AA:AA:AA", dst="BB:BB:BB:BB:BB:BB"):
    return {"source": "kismet.alerts", "row": json.dumps({"ts_sec": ts, "header": "DEAUTH", "json": "{}", "src_mac": src, "dst_mac": dst})}


def ap(ts, bssid, ssid):
    return {"source": "kismet.devices", "row": json.dumps({"devmac": bssid, "type": "Wi-Fi AP", "last_time": ts, "device": json.dumps({"dot11.device": {"dot11.device.advertised_ssid_map": [{"dot11.advertisedssid.ssid": ssid}]}})})}


def ble(ts, mac, name):
    return {"source": "kismet.devices", "row": json.dumps({"devmac": mac, "type": "BTLE Device", "last_time": ts, "device": json.dumps({"kismet.device.base.commonname": name})})}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    d = tmp_path_factory.mktemp("scenarios")
    docs = [
        scenario("burst", "suspicious", [[], [alert(T0 + 50 + i) for i in range(8)], []], True, 2, ["BB:BB:BB:BB:BB:BB"]),
        scenario("single-frame", "normal", [[alert(T0 - 5)], [], []], False),
        scenario("twin", "suspicious", [[ap(T0 - 1, "01", "home")], [ap(T0 + 55, "02", "home")]], True, 2, ["02"]),
        scenario("one-radio", "normal", [[ap(T0 - 1, "01", "home")], [ap(T0 + 55, "01", "home"), ap(T0 + 56, "09", "other")]], False),
        scenario("tag", "suspicious", [[], [ble(T0 + 58, "CC", "AirTag")]], True, 2, ["CC"]),
        scenario("headphones", "normal", [[ble(T0 - 1, "DD", "Buds")], []], False),
        scenario("future-row", "edge", [[alert(T0 + 5000 + i) for i in range(8)], []], False),
        scenario("broken-detector", "edge", [[], [alert(T0 + 50 + i) for i in range(8)], []], False, final="degraded", faults=[{"component": "deauth", "from_cycle": 1, "error": "x"}]),
        scenario("late-fault", "edge", [[alert(T0 - 10 + i) for i in range(8)], [], []], True, 1, ["BB:BB:BB:BB:BB:BB"], faults=[{"component": "ble", "from_cycle": 2, "error": "x"}]),
    ]
    for x in docs:
        (d / f"{x['scenario_id']}.json").write_text(json.dumps(x))
    return str(d)


def test_replay_meets_labels(spark, corpus):
    v = replay.verdicts(spark, corpus, ["home"])
    assert {r.scenario_id: list(r.failed) for r in v.collect()} == {n: [] for n in ("burst", "single-frame", "twin", "one-radio", "tag", "headphones", "future-row", "broken-detector", "late-fault")}
    g = replay.gates(v).first()
    assert g.scenarios == 9 and [g[x] for x in replay.GATES[:-1]] == [0] * 11 and g.worst_latency_cycles == 2


def test_replay_is_deterministic(spark, corpus):
    rows = captures.scenarios(spark, corpus)
    order = ["scenario_id", "subject", "cycle"]
    assert sinks.report_bytes(replay.replay(rows, ["home"]), order) == sinks.report_bytes(replay.replay(rows.repartition(7), ["home"]), order)


def test_evaluation(spark, corpus, tmp_path):
    good = {"gate_version": 1, "notes": "", **dict.fromkeys(replay.GATES, 0), "worst_latency_cycles": 2}
    (tmp_path / "gates.json").write_text(json.dumps(good))
    limits = replay.load_gates(str(tmp_path / "gates.json"))
    folder = lambda: str(tmp_path / uuid.uuid4().hex)
    assert replay.evaluate(spark, corpus, ["home"], limits, folder(), 5) == (0, [])
    code, why = replay.evaluate(spark, corpus, [], limits, folder())
    assert code == 2 and why == ["9 scenarios, at least 25 are needed"], "a small corpus is not judged"
    missed = "missed_scenarios"
    for bad in ({**good, "mised": 0}, {k: v for k, v in good.items() if k != missed}, {**good, missed: True}, {**good, "worst_latency_cycles": 0}, {**good, "gate_version": 2}):
        (tmp_path / "gates.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            replay.load_gates(str(tmp_path / "gates.json"))


def test_each_gate_sees_its_breach(spark, tmp_path):
    """Scenarios that are labelled wrong, or show what they must not, break their own gate."""
    burst, twin = [alert(T0 + 50 + i) for i in range(8)], [ap(T0 - 1, "01", "home"), ap(T0 - 1, "02", "home")]
    docs = [
        scenario("quiet-label", "edge", [[], burst, []], False), scenario("missed", "suspicious", [[], [], []], True, 2), scenario("late", "suspicious", [[], [], [], [alert(T0 + 170 + i) for i in range(8)]], True, 2),
        scenario("other-state", "suspicious", [[], burst], True, 2, final="alert"), scenario("other-entity", "suspicious", [[], burst], True, 2, ["CC:CC"]),
        scenario("excess", "suspicious", [twin, burst], True, 2), scenario("raw", "suspicious", [[], burst], True, 2), scenario("one-cycle", "edge", [burst], True, 1, restarts=[0]), scenario("normal-detects", "normal", [[], burst], True, 2),
    ]
    docs[5]["labels"]["expect"]["max_incidents"] = 1
    docs[6]["labels"]["expect"]["no_raw_strings"] = ["flood", "not there"]
    for x in docs:
        (tmp_path / f"{x['scenario_id']}.json").write_text(json.dumps(x))
    got = {r.scenario_id: set(r.failed) for r in replay.verdicts(spark, str(tmp_path), ["home"]).collect()}
    assert got["quiet-label"] >= {"false_alert_scenarios", "false_incident_scenarios", "state_mismatch_scenarios"}
    assert got["missed"] >= {"missed_scenarios"} and got["late"] == {"latency_breaches"} and got["other-state"] == {"state_mismatch_scenarios"} and got["other-entity"] == {"entity_mismatch_scenarios"}
    assert got["excess"] == {"excess_incident_scenarios"} and got["raw"] == {"raw_render_breaches"} and "label_violations" in got["one-cycle"] & got["normal-detects"]


def test_restarts_change_nothing(spark, corpus, tmp_path):
    """A stream that is stopped and started where scenarios say, or half-way, gives the rows of one replay; one that loses its state does not."""
    docs = spark.read.schema(captures.SCENARIO).option("multiLine", True).json(corpus)
    rows = captures.scenarios(spark, corpus)
    points = replay.restart_points(docs.withColumn("restarts", F.when(F.col("scenario_id") == "late-fault", F.array(F.lit(0), F.lit(1)))))
    assert {(r.scenario_id, r.point) for r in points.collect()} >= {("late-fault", 0), ("late-fault", 1), ("burst", 1)}
    key = lambda r: (r.scenario_id, r.subject, r.cycle, r.state, r.confidence, r.detectors)
    whole = sorted(map(key, replay.replay(rows, ["home"]).collect()))
    assert sorted(map(key, replay.restarted(rows, ["home"], points, str(tmp_path / "run")).collect())) == whole
    alone = incidents.lifecycle(replay._evidence(rows, ["home"], None).where("cycle > 28333333").drop("scenario_id"), 60.0)
    assert sorted(map(key, replay._named(alone).collect())) != [r for r in whole if r[2] > 28333333]


def test_states_of_silent_cycles(spark, tmp_path):
    """An attack, then silence: the phenomenon decays and is closed as stale."""
    (tmp_path / "x.json").write_text(json.dumps(scenario("quiet-tail", "edge", [[alert(T0 - 10 + i) for i in range(8)], *([[]] * 14)], True, 1)))
    s = replay.cycle_states(captures.scenarios(spark, str(tmp_path)), ["home"]).orderBy("cycle")
    assert [r.state for r in s.collect()] == ["watch"] * 3 + ["clear"] * 12


def test_unknown_keys(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"scenario_version": 1, "cycels": []}))
    assert [(r.file, r.key) for r in captures.unknown_keys(spark, str(tmp_path)).collect()] == [("x.json", "cycels")]


def test_restart_resumes_from_the_checkpoint(spark, tmp_path):
    """The loop is stopped between batches and started anew: every row is seen once, and a cycle that failed comes again."""
    schema = "subject long, ts double"
    seen, fail = [], [True]

    def cycle(batch, number):
        rows = sorted(r.subject for r in batch.collect())
        if 7 in rows and fail:
            fail.clear()
            raise RuntimeError("lost power")
        seen.append((number, rows))

    for k, part in enumerate(([1, 2], [7], [8, 9])):
        spark.createDataFrame([(x, 0.0) for x in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            q = live.run_cycles(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), cycle, str(tmp_path / "checkpoint"), None)
            try:
                q.awaitTermination(120)
            except Exception:
                assert k == 1
    assert seen == [(0, [1, 2]), (1, [7]), (2, [8, 9])]


def test_scans(spark):
    from skysift.plans import scans

    alerts = spark.createDataFrame([(T0 + i, "DEAUTHFLOOD", '{"kismet.alert.channel": "6"}', "aa", "bb", None) for i in range(12)] + [(T0, "APSPOOF", "{}", None, "cc", None), (T0 - 9999, "DEAUTH", "{}", "aa", "bb", None)], captures.ALERTS)
    dev = json.dumps({"dot11.device": {"dot11.device.client_map": {"ap1": {"dot11.client.retries": 60, "dot11.client.tx_packets": 100}, "ap2": {"dot11.client.retries": 60, "dot11.client.tx_packets": 200}}, "dot11.device.advertised_ssid_map": [{"dot11.advertisedssid.ssid": "home"}]}, "kismet.device.base.channel": "6"})
    devices = spark.createDataFrame([("m1", "Wi-Fi AP", dev, T0, None, None, None), ("m2", "Wi-Fi AP", dev, T0 + 5, None, None, None), ("m3", "x", "{bad", T0, None, None, None)], captures.DEVICES)
    attacks, retries = scans.deauth_scan(alerts, devices, T0 + 60)
    assert [(r.target, r.source, r.n, list(r.channels), r.severity) for r in attacks.collect()] == [("BB", "AA", 12, [6], "MEDIUM")]
    assert sorted((r.target, r.source) for r in retries.collect()) == [("M1", "AP1"), ("M2", "AP1")]
    assert scans.deauth_scan(alerts, devices, T0 + 60, protected=["zz"])[0].count() == 0
    trusted = spark.createDataFrame([("home", "M1", 6)], "ssid string, bssid string, channel int")
    new, checked, said = scans.rogue_scan(devices, alerts, T0 + 60, trusted)
    assert [(r.ssid, r.bssid) for r in new.collect()] == [("home", "M2")] and {r.bssid: r.verdict for r in checked.collect()} == {"M1": "trusted", "M2": "CRITICAL"}
    assert [r.ssid for r in said.collect()] == ["[Kismet Alert: APSPOOF]"]


def test_scenario_problems(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"scenario_version": 2, "scenario_id": "x", "labels": {"kind": "odd"}, "cycles": []}))
    assert {r.problem for r in captures.scenario_problems(spark, str(tmp_path)).collect()} == {"version", "labels.kind", "cycles"}


def test_readers(spark, tmp_path):
    (tmp_path / "l.txt").write_text("macs = ['aa', 'bb',\n 'aa', ]")
    assert sorted(r.subject for r in captures.ignore_list(spark, str(tmp_path / "l.txt")).collect()) == ["AA", "BB"]
    (tmp_path / "p.log").write_text("x\n2024-01-01 10:00:00 start\nProbing for: cafe\nProbing for: home\n2024-01-02 00:00:00\nprobe: z\n")
    got = captures.probe_log(spark, str(tmp_path / "p.log")).orderBy("line").collect()
    assert [(r.stamp, r.ssid) for r in got] == [("2024-01-01 10:00:00", "cafe"), ("2024-01-01 10:00:00", "home"), ("2024-01-02 00:00:00", "z")]
    assert captures.newest(spark, str(tmp_path), "*.txt").endswith("l.txt")
    d = spark.createDataFrame([("a", '{"dot11.device": {"dot11.device.last_probed_ssid_record": {"dot11.probedssid.ssid": "n"}}}', 1.0), ("b", "{bad", 2.0), ("c", "{}", 3.0)], "devmac string, device string, last_time double")
    assert captures.devices_between(d, 1.0, 2.0).count() == 2 and [r.ssid for r in captures.probes_between(d, 1.0).collect()] == ["n"]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("aa", T0, -40.0), (None, T0, 1.0)], "mac string, ts double, rssi double")
    n = normalize.ble_advertisements(a, "s")
    sinks.append_observations(n, str(tmp_path / "log"), str(tmp_path / "bad"))
    sinks.append_observations(n, str(tmp_path / "log"), str(tmp_path / "bad"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and spark.read.json(str(tmp_path / "bad")).count() == 2
    sinks.export_scenario(log, str(tmp_path / "cycles"), 60.0)
    out = spark.read.json(str(tmp_path / "cycles")).collect()
    assert [(r.cycle_id, r.clock_ts) for r in out] == [(int(T0 // 60), T0)] * 2
    sinks.save_ignore_list(spark.createDataFrame([("B",), ("A",), ("A",)], "subject string"), str(tmp_path / "ignore"))
    assert sorted(r.subject for r in captures.ignore_list(spark, str(tmp_path / "ignore")).collect()) == ["A", "B"]
    sinks.append_heartbeat(spark, str(tmp_path / "beats"), "analyzer", 1.0, True)
    sinks.append_heartbeat(spark, str(tmp_path / "beats"), "analyzer", 2.0, False, "x")
    assert spark.read.parquet(str(tmp_path / "beats")).count() == 2
    status = incidents.status_rollup(spark.createDataFrame([("k", "alert", 100.0)], "incident_key string, severity string, last_ts double"), 120.0)
    sinks.publish_status(status, str(tmp_path / "status"))
    assert spark.read.json(str(tmp_path / "status")).first().state == "alert"


def drain(spark, frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, live.ROCKSDB)
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_reappearance_stream_equals_batch(rocks, tmp_path):
    spark = rocks
    rows = [(s, float(t)) for s in range(5) for t in (10 + s, 400, 950, 2000 * s)]
    df = spark.createDataFrame(rows, "subject long, ts double")
    for i in range(3):
        df.where(f"floor(ts / 1000) = {i}" if i < 2 else "ts >= 2000").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {(r.subject, r.label) for r in drain(spark, live.reappearance_stream(stream, 300.0), "slots").collect()}
    assert got == {(r.subject, r.label) for r in windows.reappearances(df, 300.0).collect()}


def test_lifecycle_stream_equals_batch(rocks, tmp_path):
    spark = rocks
    rows = [(f"p{i % 3}", c, ("deauth", "cotravel")[i % 2], ("deauth_pattern", "copresence")[i % 2], str(i), 0.35, False) for i, c in enumerate((1, 1, 2, 2, 3, 4, 9, 30, 31))]
    s = "phenomenon string, cycle bigint, detector string, kind string, detail string, w double, contra boolean"
    df = spark.createDataFrame(rows, s)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = drain(spark, live.lifecycle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 60.0), "machines")
    key = lambda r: (r.phenomenon, r.cycle, r.state, r.confidence, r.detectors)
    own = {(r[0], r[1]) for r in rows}
    got = out.collect()
    assert sorted(key(r) for r in got if (r.phenomenon, r.cycle) in own) == sorted(map(key, incidents.lifecycle(df, 60.0).collect()))
    assert {r.state for r in got if (r.phenomenon, r.cycle) not in own} <= {"WATCH", "OBSERVING", "RESOLVED"}, "cycles in between are told of where silence moves the state"


def test_burst_windows(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, T0 + i) for i in range(12)], "target int, source int, ts double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    good, ahead = live.trusted_times(stream, F.lit(T0 + 100))
    out = drain(spark, live.burst_windows(good, 60, 60), "bursts", "complete")
    assert sum(r.n for r in out.collect()) == 12
