"""Deterministic replay of scenario documents: rows to detections to lifecycle to verdicts, as one pure plan over all scenarios at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysift.functions.columns import DEAUTH_KEYWORDS, TRACKER_NAMES, contains_any, neutral_text, normalize_mac, state_of
from skysift.operators import incidents, normalize
from skysift.sources import captures
from skysift.streaming import live

CYCLE_S = 60.0
STATES = {"ALERT": 3, "WATCH": 2, "OBSERVING": 1, "NEW": 0, "RESOLVED": 0}


def _lines(df: DataFrame, detector: str, subject: F.Column, lines: F.Column) -> DataFrame:
    d = df.select("scenario_id", "cycle_id", "clock_ts", F.lit(detector).alias("detector"), subject.alias("subject"), F.explode(lines).alias("l"))
    return d.select("scenario_id", "cycle_id", "clock_ts", "detector", "subject", "l.kind", "l.detail").where("kind is not null")


def detections(rows: DataFrame, monitored: list[str], least: int = 5, window: float = 1800.0) -> DataFrame:
    """Evidence lines (scenario_id, cycle_id, clock_ts, detector, subject, kind, detail) of the deauthentication, rogue and tracker detectors.

    A cycle sees what is stamped at or before its clock; an attack or a tracker is filed again only when its last sighting has moved on."""
    clocks = rows.select("scenario_id", "cycle_id", "clock_ts").distinct()
    line = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    schema = "devmac string, type string, device string, last_time double, ts_sec double, header string, json string, src_mac string, dst_mac string, bssid string"
    parsed = rows.where("row is not null").select("scenario_id", "source", F.from_json("row", schema).alias("r")).select("scenario_id", "source", "r.*")
    alerts = parsed.where("source = 'kismet.alerts'")
    v = F.try_parse_json("json")
    target = normalize_mac(F.coalesce(F.nullif("dst_mac", F.lit("")), normalize.at(v, "kismet.alert.dest_mac"), F.lit("FF:FF:FF:FF:FF:FF")))
    source = normalize_mac(F.coalesce(F.nullif("src_mac", F.lit("")), normalize.at(v, "kismet.alert.source_mac"), F.lit("")))
    frames = alerts.where(contains_any(F.concat_ws(" ", "header", normalize.at(v, "kismet.alert.text")), DEAUTH_KEYWORDS)).select("scenario_id", F.col("ts_sec").alias("ts"), target.alias("target"), source.alias("source_mac"))
    f = frames.join(clocks, "scenario_id").where((F.col("ts") <= F.col("clock_ts")) & (F.col("ts") >= F.col("clock_ts") - window))
    g = f.groupBy("scenario_id", "cycle_id", "clock_ts", "target", "source_mac").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).where(F.col("n") >= least)
    before = Window.partitionBy("scenario_id", "target", "source_mac").orderBy("cycle_id").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_p", F.max("last_ts").over(before)).where("_p is null or last_ts > _p")
    deauth = _lines(g, "deauth", F.col("target"), F.array(line("deauth_pattern", F.col("n").cast("string")), line("attack_signature", F.lit("flood")), line("source_severity", F.lit("scan"))))
    dev = parsed.where("source = 'kismet.devices'")
    pairs = "array<struct<`dot11.advertisedssid.ssid`:string,`dot11.advertisedssid.crypt_string`:string>>"
    nets = F.from_json(F.to_json(F.try_variant_get(F.try_parse_json("device"), '$["dot11.device"]["dot11.device.advertised_ssid_map"]', "variant")), pairs)
    ap = dev.select("scenario_id", normalize_mac("devmac").alias("bssid"), F.col("last_time").alias("ts"), F.explode(nets).alias("n")).select("scenario_id", "bssid", "ts", F.col("n").getField("dot11.advertisedssid.ssid").alias("ssid")).where(F.col("ssid").isin(monitored))
    first = ap.groupBy("scenario_id", "ssid", "bssid").agg(F.min("ts").alias("first_ts"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("scenario_id", "ssid").orderBy("first_ts", "bssid"))).where("nth > 1")
    seen = first.join(clocks, "scenario_id").where("first_ts <= clock_ts").groupBy("scenario_id", "ssid", "bssid").agg(F.min(F.struct("cycle_id", "clock_ts")).alias("c"))
    rogue = _lines(seen.select("scenario_id", "bssid", "ssid", "c.cycle_id", "c.clock_ts"), "rogue", F.col("bssid"), F.array(line("rogue_reason", F.lit("unknown radio")), line("rogue_reason", F.lit("network is monitored"))))
    name = F.coalesce(normalize.at(F.try_parse_json("device"), "kismet.device.base.commonname"), normalize.at(F.try_parse_json("device"), "kismet.device.base.name"), F.lit(""))
    ble = dev.where(F.lower("type").rlike("btle|bluetooth")).select("scenario_id", normalize_mac("devmac").alias("mac"), F.col("last_time").alias("ts"), name.alias("name")).where(F.col("name").rlike(TRACKER_NAMES))
    b = ble.join(clocks, "scenario_id").where((F.col("ts") <= F.col("clock_ts")) & (F.col("ts") > F.col("clock_ts") - 120))
    b = b.select("scenario_id", "cycle_id", "clock_ts", "mac").distinct()
    tracker = _lines(b, "ble", F.col("mac"), F.array(line("ble_signal", F.lit("phy")), line("ble_signal", F.lit("name")), line("score", F.lit("tracker"))))
    return deauth.unionByName(rogue).unionByName(tracker)


def _without_faulty(lines: DataFrame, faults: DataFrame | None) -> DataFrame:
    """A detector that has a fault from some cycle on files nothing from then on."""
    if faults is None:
        return lines
    f = faults.groupBy("scenario_id", F.col("component").alias("detector")).agg(F.min("from_cycle").alias("_from"))
    return lines.join(f, ["scenario_id", "detector"], "left").where(F.col("_from").isNull() | (F.col("cycle_id") < F.col("_from"))).drop("_from")


def _evidence(rows: DataFrame, monitored: list[str], faults: DataFrame | None) -> DataFrame:
    """The lifecycle's input: weighed lines (scenario_id, phenomenon, cycle, ...), and a row without a detector for each later clock of their scenario."""
    found = _without_faulty(detections(rows, monitored), faults)
    d = incidents.weigh(found).withColumn("contra", F.lit(False))
    d = d.withColumns({"phenomenon": F.concat_ws("\t", "scenario_id", "subject"), "cycle": F.floor(F.col("clock_ts") / CYCLE_S).cast("long")})
    clocks = rows.select("scenario_id", F.floor(F.col("clock_ts") / CYCLE_S).cast("long").alias("cycle")).distinct()
    first = d.groupBy("scenario_id", "phenomenon").agg(F.min("cycle").alias("_first"))
    ticks = first.join(clocks, "scenario_id").where(F.col("cycle") > F.col("_first")).select("scenario_id", "phenomenon", "cycle", *(F.lit(None).cast(t).alias(c) for c, t in (("detector", "string"), ("kind", "string"), ("detail", "string"), ("w", "double"), ("contra", "boolean"))))
    return d.select(*ticks.columns).unionByName(ticks)


def _named(states: DataFrame) -> DataFrame:
    part = F.split("phenomenon", "\t")
    return states.select(part[0].alias("scenario_id"), part[1].alias("subject"), "cycle", "state", "confidence", "detectors")


def replay(rows: DataFrame, monitored: list[str], faults: DataFrame | None = None) -> DataFrame:
    """(scenario_id, subject, cycle, state, confidence, detectors) after each cycle with evidence, and after each later one of the scenario's clocks."""
    return _named(incidents.lifecycle(_evidence(rows, monitored, faults).drop("scenario_id"), CYCLE_S))


def restart_points(docs: DataFrame) -> DataFrame:
    """docs (scenario_id, restarts, cycles) -> (scenario_id, point): the cycles after which a scenario is restarted; half-way where it names none."""
    declared = F.coalesce("restarts", F.array().cast("array<int>"))
    half = F.array(F.floor(F.size("cycles") / 2).cast("int"))
    return docs.select("scenario_id", F.explode(F.when(F.size(declared) > 0, declared).otherwise(half)).alias("point")).distinct()


def restarted(rows: DataFrame, monitored: list[str], points: DataFrame, folder: str, faults: DataFrame | None = None) -> DataFrame:
    """The rows of replay(), from a lifecycle stream that is stopped after each scenario's first restart point, started anew from its checkpoint in `folder`, stopped
    after the second ones, and so on. There are as many runs as a scenario has points, and one more."""
    spark = rows.sparkSession
    clocks = rows.select("scenario_id", "cycle_id", F.floor(F.col("clock_ts") / CYCLE_S).cast("long").alias("cycle")).distinct()
    passed = clocks.join(points, "scenario_id", "left").groupBy("scenario_id", "cycle").agg(F.count_if(F.col("cycle_id") > F.col("point")).alias("segment"))
    parts = _evidence(rows, monitored, faults).join(passed, ["scenario_id", "cycle"])
    parts.drop("scenario_id").write.mode("overwrite").partitionBy("segment").parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    schema = parts.drop("segment").schema
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, live.ROCKSDB)
    try:
        for segment in range((parts.agg(F.max("segment")).first()[0] or 0) + 1):
            parts.where(F.col("segment") == segment).drop("segment").coalesce(1).write.parquet(f"{folder}/in/{segment}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
            states = live.lifecycle_stream(stream, CYCLE_S, timers=False)
            q = states.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return _named(spark.read.schema(incidents.LIFECYCLE_SCHEMA).parquet(f"{folder}/out"))


def digests(states: DataFrame) -> DataFrame:
    """(scenario_id, digest) over all of a scenario's rows, whatever their order."""
    row = F.to_json(F.struct("subject", "cycle", "state", "confidence", "detectors"))
    return states.groupBy("scenario_id").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(row))), 256).alias("digest"))


def cycle_states(rows: DataFrame, monitored: list[str], faults: DataFrame | None = None) -> DataFrame:
    """(scenario_id, cycle, state): what would be published after each cycle: alert and watch by the phenomena that stand, degraded by a faulty detector."""
    clocks = rows.select("scenario_id", "cycle_id", F.floor(F.col("clock_ts") / CYCLE_S).cast("long").alias("cycle")).distinct()
    s = replay(rows, monitored, faults).groupBy("scenario_id", "cycle").agg(F.bool_or(F.col("state") == "ALERT").alias("alert"), F.bool_or(F.col("state") == "WATCH").alias("watch"))
    j = clocks.join(s, ["scenario_id", "cycle"], "left")
    broken = F.lit(False)
    if faults is not None:
        j = j.join(faults.groupBy("scenario_id").agg(F.min("from_cycle").alias("_from")), "scenario_id", "left")
        broken = F.coalesce(F.col("cycle_id") >= F.col("_from"), F.lit(False))
    no = F.lit(False)
    return j.select("scenario_id", "cycle", state_of(no, F.coalesce("alert", no), F.coalesce("watch", no), broken).alias("state"))


def label_problems(docs: DataFrame) -> DataFrame:
    """(scenario_id, problem): labels that the gates cannot judge by."""
    e = F.col("labels.expect")
    says = lambda c, *states: ~F.coalesce(F.col("labels.expect.state").isin(*states), F.lit(False)) & c
    detect, kind = F.coalesce(e["detect"], F.lit(False)), F.col("labels.kind")
    only = F.array(*(F.when(e[c].isNotNull(), c) for c in ("max_latency_cycles", "entity_keys", "max_incidents")))
    blank = lambda c: F.coalesce((F.size(e[c]) == 0) | F.exists(e[c], lambda x: F.coalesce(x, F.lit("")) == ""), F.lit(False)) & e[c].isNotNull()
    bad = F.array_compact(F.array(
        F.when(~F.coalesce(kind.isin("normal", "suspicious", "edge"), F.lit(False)), "kind"), F.when(e["detect"].isNull(), "detect"),
        F.when(says(detect, "watch", "alert", "degraded") | says(~detect, "clear", "degraded"), "state"), F.when(detect & (F.coalesce(e["max_latency_cycles"], F.lit(0)) < 1), "max_latency_cycles"),
        F.when(~detect & (F.size(F.array_compact(only)) > 0), "fields of a detection"), F.when((kind == "normal") & detect | (kind == "suspicious") & ~detect, "kind and detect"),
        F.when(blank("entity_keys"), "entity_keys"), F.when(blank("no_raw_strings"), "no_raw_strings"), F.when(e["max_incidents"] < 1, "max_incidents"), F.when(F.size("cycles") < 2, "one cycle"),
    ))
    return docs.select("scenario_id", F.explode(bad).alias("problem"))


def rendered(rows: DataFrame, monitored: list[str], faults: DataFrame | None = None) -> DataFrame:
    """(scenario_id, text): a line for each piece of evidence, as reports show it."""
    d = _without_faulty(detections(rows, monitored), faults)
    return d.select("scenario_id", neutral_text(F.concat_ws(" ", "detector", "subject", "kind", "detail")).alias("text"))


def verdicts(spark: SparkSession, path: str, monitored: list[str], folder: str | None = None) -> DataFrame:
    """(scenario_id, kind, detected, latency, entities, final_state, failed): each scenario against its labels; failed lists the gates it breaks.

    Every scenario is replayed a second time over other partitions, and, if a folder is given, by a stream with restarts: both have to give the same rows. Without
    a folder the restarts are not judged."""
    rows = captures.scenarios(spark, path)
    docs = spark.read.schema(captures.SCENARIO).option("multiLine", True).json(path)
    faults = docs.select("scenario_id", F.explode("faults").alias("f")).select("scenario_id", "f.*")
    start = rows.groupBy("scenario_id").agg(F.min(F.floor(F.col("clock_ts") / CYCLE_S)).alias("start"))
    states = replay(rows, monitored, faults)
    hot = F.when(F.col("state").isin("WATCH", "ALERT"), F.col("cycle"))
    hot = states.groupBy("scenario_id").agg(F.min(hot).alias("first"), F.array_sort(F.collect_set("subject")).alias("entities"))
    last = cycle_states(rows, monitored, faults).groupBy("scenario_id").agg(F.max_by("state", "cycle").alias("final_state"))
    none = F.array().cast("array<string>")
    j = docs.select("scenario_id", "labels").join(start, "scenario_id", "left").join(hot, "scenario_id", "left").join(last, "scenario_id", "left").withColumn("entities", F.coalesce("entities", none))
    once = digests(states)
    others = {"determinism_breaches": replay(rows.repartition(7, F.xxhash64("row")), monitored, faults)}
    if folder is not None:
        others["restart_breaches"] = restarted(rows, monitored, restart_points(docs), folder, faults)
    for gate, other in others.items():
        same = once.join(digests(other).withColumnRenamed("digest", "other"), "scenario_id", "full").select("scenario_id", (~F.col("digest").eqNullSafe(F.col("other"))).alias(gate))
        j = j.join(same, "scenario_id", "left")
    needles = docs.select("scenario_id", F.explode("labels.expect.no_raw_strings").alias("needle")).where("needle <> ''")
    shown = rendered(rows, monitored, faults).join(needles, "scenario_id").where(F.contains("text", "needle")).select("scenario_id", F.lit(True).alias("raw_render_breaches")).distinct()
    wrong = label_problems(docs).select("scenario_id", F.lit(True).alias("label_violations")).distinct()
    j = j.join(shown, "scenario_id", "left").join(wrong, "scenario_id", "left")
    detected, want = F.col("first").isNotNull(), F.coalesce("labels.expect.detect", F.lit(False))
    latency, n = F.col("first") - F.col("start") + 1, F.size("entities")
    failed = F.array_compact(F.array(
        F.when(detected & ~want, "false_alert_scenarios"), F.when((n > 0) & ~want, "false_incident_scenarios"), F.when((~detected | (n == 0)) & want, "missed_scenarios"),
        F.when(detected & (latency > F.col("labels.expect.max_latency_cycles")), "latency_breaches"), F.when(F.col("labels.expect.state").isNotNull() & (F.col("final_state") != F.col("labels.expect.state")), "state_mismatch_scenarios"),
        F.when(F.col("labels.expect.entity_keys").isNotNull() & (F.col("entities") != F.array_sort("labels.expect.entity_keys")), "entity_mismatch_scenarios"),
        F.when(n > F.col("labels.expect.max_incidents"), "excess_incident_scenarios"), *(F.when(F.col(g), g) for g in (*others, "raw_render_breaches", "label_violations")),
    ))
    return j.select("scenario_id", F.col("labels.kind").alias("kind"), detected.alias("detected"), latency.alias("latency"), "entities", "final_state", failed.alias("failed"))


#: A gates document's version, the gates and how many scenarios a corpus has at least.
GATES_VERSION = 1
GATES = [
    "false_alert_scenarios", "false_incident_scenarios", "missed_scenarios", "latency_breaches", "state_mismatch_scenarios", "entity_mismatch_scenarios", "excess_incident_scenarios", "determinism_breaches",
    "restart_breaches", "raw_render_breaches", "label_violations", "worst_latency_cycles",
]
LEAST_SCENARIOS = 25


def gates(v: DataFrame) -> DataFrame:
    """One row: scenarios, how many of them break each gate, and the worst latency of a first detection."""
    return v.agg(F.count("*").alias("scenarios"), *(F.count_if(F.array_contains("failed", g)).alias(g) for g in GATES[:-1]), F.coalesce(F.max("latency"), F.lit(0)).alias(GATES[-1]))


def load_gates(path: str) -> dict[str, int]:
    """A gates document, strictly: a misspelt or missing gate must not read as a green run."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    if not isinstance(doc, dict) or doc.get("gate_version") != GATES_VERSION:
        raise ValueError(f"gate_version must be {GATES_VERSION}")
    own = {k: v for k, v in doc.items() if k not in ("gate_version", "notes")}
    bad = sorted({*own} ^ {*GATES}) + sorted(k for k, v in own.items() if isinstance(v, bool) or not isinstance(v, int) or v < (k == GATES[-1]))
    if bad:
        raise ValueError(f"unknown, missing or wrong gates: {', '.join(bad)}")
    return own


def evaluate(spark: SparkSession, path: str, monitored: list[str], thresholds: dict[str, int], folder: str, least: int = LEAST_SCENARIOS) -> tuple[int, list[str]]:
    """(exit code, what failed): 0 if every gate holds, 1 if one does not, 2 if the corpus cannot be judged. `folder` takes the stream that is restarted."""
    problems = [f"{r.scenario_id}: {r.problem}" for r in captures.scenario_problems(spark, path).limit(100).collect()]
    problems += [f"{r.file}: unknown key {r.key}" for r in captures.unknown_keys(spark, path).limit(100).collect()]
    got = gates(verdicts(spark, path, monitored, folder)).first()
    if got["scenarios"] < least:
        problems.append(f"{got['scenarios']} scenarios, at least {least} are needed")
    if problems:
        return 2, problems
    over = [f"{g}: {got[g]} over {thresholds[g]}" for g in GATES if got[g] > thresholds[g]]
    return (1 if over else 0), over


def raw_strings(texts: DataFrame, column: str, needles: list[str]) -> DataFrame:
    """Rows of rendered text that show a string which must not be shown."""
    hit = F.lit(False)
    for n in filter(None, needles):
        hit = hit | F.contains(F.col(column), F.lit(n))
    return texts.where(hit)
