"""Queries over the engine's tables and texts, with their DuckDB oracles; catalog.py holds the decorator and the binding of the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.functions import columns as C
from skysift.operators import control, geo, identity, legacy_stats, normalize, reports, store, windows
from skysift.plans import catalog
from skysift.plans.catalog import _DE, DAY, NOW, ORACLES, deauths, query
from skysift.sources import ingest, legacy
from skysift.sources.bindings import OBS, observations, table

STATES = ["new", "observing", "watch", "alert", "resolved", "false_positive"]
FAMILIES = ["ble_tracker", "deauth_flood", "rogue_ap", "mac_reappear"]


def _pick(names: list[str], i) -> F.Column:
    return F.get(F.array(*(F.lit(n) for n in names)), i.cast("int"))


# ---- observations and keyed tables -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, ts, subject, kind FROM obs WHERE ts >= {NOW} - 20 * {DAY} AND ts <= {NOW} AND kind = 'view' ORDER BY ts, id LIMIT 5000")
def observation_query(spark, d):
    """A read with some of the optional filters; a limit beyond 5,000 is held there."""
    return store.query_observations(observations(spark, d), 9999, NOW - 20 * DAY, NOW, kind="view", subject=None).select("id", "ts", "subject", "kind")


@query("SELECT id, ts, subject, kind FROM obs WHERE id = 7")
def observation_point(spark, d):
    return store.point(observations(spark, d), "id", 7).select("id", "ts", "subject", "kind")


@query("SELECT * FROM (SELECT id, ts, kind FROM obs WHERE subject = 5 ORDER BY ts, id)")
def child_listing(spark, d):
    return store.children(observations(spark, d), "subject", 5, ["ts", "id"]).select("id", "ts", "kind")


@query("SELECT id, subject FROM (SELECT id, subject, row_number() OVER (PARTITION BY subject ORDER BY ts, id) AS nr FROM obs) WHERE nr <= 20")
def history_first_reads(spark, d):
    """The oldest rows of each identity, as a capped read gives them."""
    return store.first_reads(observations(spark, d), ["subject"], 20).select("id", "subject")


@query(f"SELECT key_a, key_b, confidence, status FROM ({ORACLES['hypothesis_merge']}) WHERE status = 'linked' AND (key_a = 3 OR key_b = 3) ORDER BY confidence DESC, key_a, key_b LIMIT 100", obs=False)
def hypothesis_listing(spark, d):
    return store.hypotheses(catalog.hypothesis_merge(spark, d), "linked", 3).select("key_a", "key_b", "confidence", "status")


def _prints(spark, d):
    o = observations(spark, d)
    entities = o.select(F.col("subject").alias("entity_id"), F.lit("wifi_mac").alias("kind"), F.concat(F.lit("m"), F.col("subject").cast("string")).alias("key")).distinct()
    links = o.select(F.col("subject").alias("entity_id"), (F.col("k") % 16).alias("fingerprint")).distinct()
    prints = links.select("fingerprint").distinct().select("fingerprint", F.sha1(F.col("fingerprint").cast("string")).alias("hash"), F.concat(F.lit("tags="), F.col("fingerprint").cast("string")).alias("features"))
    return entities, links, prints


@query("SELECT DISTINCT k % 16 AS fingerprint, 'm' || subject AS key FROM obs")
def fingerprint_macs(spark, d):
    entities, links, _ = _prints(spark, d)
    return store.fingerprint_members(links, entities)


@query("SELECT DISTINCT 'wifi_mac' AS kind, 'm' || subject AS key, k % 16 AS fingerprint, sha1((k % 16)::VARCHAR) AS hash, 'tags=' || (k % 16) AS features FROM obs")
def identity_features(spark, d):
    return store.identity_features(*_prints(spark, d))


@query("SELECT subject, arg_min(ts - k, id) AS first_seen, arg_max(ts, id) AS last_seen, arg_max(k, id) AS location_count, arg_max(value, id) AS score FROM obs WHERE kind = 'purchase' GROUP BY subject")
def cotravel_upsert(spark, d):
    return store.cotravel_upsert(_cotravel(spark, d), ["subject"])


def _cotravel(spark, d):
    return observations(spark, d).where("kind = 'purchase'").select("id", "subject", (F.col("ts") - F.col("k")).alias("first_seen"), F.col("ts").alias("last_seen"), F.col("k").alias("location_count"), F.col("value").alias("score"))


@query("SELECT k AS hash, arg_min(ts, id) AS first_seen, arg_max(ts, id) AS last_seen, arg_max(kind, id) AS features FROM obs GROUP BY k")
def fingerprint_upsert(spark, d):
    return store.fingerprint_upsert(observations(spark, d).select("id", "ts", F.col("k").alias("hash"), F.col("kind").alias("features")), ["hash"])


@query("SELECT kind AS key, max(id) AS id, arg_max(value, id) AS value, arg_max(ts, id) AS ts FROM obs GROUP BY kind")
def runtime_values(spark, d):
    """The last value of each runtime key (U10, Z3); heartbeats and the status history are read likewise (K5, K6)."""
    return store.latest(observations(spark, d).withColumnRenamed("kind", "key"), ["key"], "id", ["value", "ts"]).join(
        observations(spark, d).groupBy(F.col("kind").alias("key")).agg(F.max("id").alias("id")), "key"
    ).select("key", "id", "value", "ts")


def _flags(spark, d):
    return store.ignore_flags(observations(spark, d).where("kind = 'signup'").select("id", "subject", (F.col("k") % 2 == 0).alias("ignore")), ["subject"])


_FLAGS = "fl AS (SELECT subject, arg_max(k % 2 = 0, id) AS ignore FROM obs WHERE kind = 'signup' GROUP BY subject)"


@query(f"+ {_FLAGS} SELECT subject, count(*) AS n FROM obs WHERE kind = 'view' AND subject NOT IN (SELECT subject FROM fl WHERE ignore) GROUP BY subject")
def entity_ignore(spark, d):
    """Rows of entities whose standing flag is not ignore."""
    return store.not_ignored(observations(spark, d).where("kind = 'view'"), _flags(spark, d), ["subject"]).groupBy("subject").agg(F.count("*").alias("n"))


def _baselines(spark, d):
    k, kind = F.col("k"), F.col("kind")
    action = F.when((kind == "signup") & (k < 20), "manual").when((kind == "purchase") & (k < 5), "mark_false").when((kind == "error") & (k < 10), "forget").otherwise("see")
    return store.baselines(observations(spark, d).select("id", "ts", (k % 4).alias("place"), "subject", action.alias("action")), ["place", "subject"], 6)


_BA = """ac AS (SELECT id, ts, k % 4 AS place, subject, CASE WHEN kind = 'signup' AND k < 20 THEN 'manual' WHEN kind = 'purchase' AND k < 5 THEN 'mark_false' WHEN kind = 'error' AND k < 10 THEN 'forget' ELSE 'see' END AS action FROM obs),
a1 AS (SELECT *, max(id) FILTER (action = 'forget') OVER (PARTITION BY place, subject) AS gone FROM ac), a2 AS (SELECT *, min(id) FILTER (action IN ('manual', 'mark_false')) OVER (PARTITION BY place, subject) AS told FROM a1 WHERE action <> 'forget' AND (gone IS NULL OR id > gone)),
a3 AS (SELECT place, subject, arg_min(ts, id) AS first_seen, arg_max(ts, id) AS last_seen, count(*) FILTER (action = 'see' AND (told IS NULL OR id < told)) AS b, count(*) FILTER (action = 'see' AND id > told) AS a, arg_max(action, id) FILTER (action <> 'see') AS src FROM a2 GROUP BY place, subject),
ba AS (SELECT place, subject, first_seen, last_seen, CASE WHEN src IS NULL THEN b ELSE greatest(b, 6) + a END AS sightings, coalesce(src, CASE WHEN b >= 6 THEN 'learned' ELSE 'candidate' END) AS source FROM a3)"""


@query(f"+ {_BA} SELECT * FROM ba")
def baseline_commands(spark, d):
    """Baselines as sightings, marks by hand and forgetting leave them."""
    return _baselines(spark, d)


@query(f"+ {_BA} SELECT place, subject, sightings, source, last_seen FROM ba WHERE source <> 'candidate' ORDER BY place, last_seen DESC, subject")
def baseline_listing(spark, d):
    return store.list_baselines(_baselines(spark, d)).select("place", "subject", "sightings", "source", "last_seen")


@query(f"""+ {_BA}, {_FLAGS} SELECT s.place, s.subject, concat_ws('; ', CASE WHEN fl.ignore THEN 'entity marked ignore / mark_false' END, CASE WHEN ba.subject IS NOT NULL THEN 'baseline for place=' || s.place END) AS reasons
FROM (SELECT DISTINCT k % 4 AS place, subject FROM obs) s LEFT JOIN fl ON fl.subject = s.subject LEFT JOIN ba ON ba.place = s.place AND ba.subject = s.subject AND ba.source <> 'candidate'""")
def suppression_reasons(spark, d):
    s = observations(spark, d).select((F.col("k") % 4).alias("place"), "subject").distinct()
    return store.explain_suppression(s, _flags(spark, d), _baselines(spark, d), ["subject"]).withColumn("reasons", F.array_join("reasons", "; "))


@query("SELECT k % 3 AS slot, array_to_string(list_sort(list(DISTINCT subject)), ',') AS subjects FROM obs GROUP BY 1")
def slot_sets(spark, d):
    """Each slot's subjects as a sorted array."""
    s = windows.slot_sets(observations(spark, d).select("subject", (F.col("k") % 3).alias("slot")), "slot", "subject")
    return s.select("slot", F.array_join(F.transform("subjects", lambda x: x.cast("string")), ",").alias("subjects"))


@query(f"SELECT kind AS name, count(*) FILTER (ts >= {NOW} - CASE kind WHEN 'view' THEN 7 WHEN 'click' THEN 7 WHEN 'error' THEN 14 ELSE 30 END * 86400) AS kept FROM obs WHERE kind <> 'signup' GROUP BY kind")
def retention_classes(spark, d):
    """What each table keeps by its class: 7, 7, 14 and 30 days."""
    o = observations(spark, d)
    kinds = {"view": "observations", "click": "events", "error": "heartbeats", "purchase": "status_history"}
    kept = store.retained({t: o.where(F.col("kind") == k) for k, t in kinds.items()}, NOW)
    parts = [kept[t].agg(F.lit(k).alias("name"), F.count("*").alias("kept")) for k, t in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT DISTINCT k FROM obs WHERE kind = 'view' AND k NOT IN (SELECT k FROM obs WHERE kind = 'signup' AND k % 2 = 0)")
def unknown_keys(spark, d):
    """Keys on one side that the other does not know."""
    o = observations(spark, d)
    return o.where("kind = 'view'").select("k").subtract(o.where("kind = 'signup' AND k % 2 = 0").select("k"))


# ---- incidents -------------------------------------------------------------------------------------------------------------------------------------------


def _phenomena(spark, d):
    s = F.col("subject")
    g = observations(spark, d).groupBy("subject").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    return g.select(
        s.alias("entity_id"), store.phenomenon_key(F.lit("dev"), s).alias("incident_key"), "first_seen", "last_seen", "n", _pick(STATES, s % 6).alias("lifecycle_state"),
        F.when(s % 6 < 4, "open").otherwise("closed").alias("status"), (s % 7 == 0).alias("suppressed"), _pick(FAMILIES, s % 4).alias("event_type"),
    )


_PH = f"""ph AS (SELECT subject AS entity_id, 'ph:dev:' || subject AS incident_key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, {STATES}[subject % 6 + 1] AS lifecycle_state,
 CASE WHEN subject % 6 < 4 THEN 'open' ELSE 'closed' END AS status, subject % 7 = 0 AS suppressed, {FAMILIES}[subject % 4 + 1] AS event_type FROM obs GROUP BY subject)"""


@query(f"+ {_PH} SELECT lifecycle_state, count(*) AS n FROM ph WHERE status = 'open' GROUP BY 1")
def open_by_state(spark, d):
    return store.open_by_state(_phenomena(spark, d))


@query(f"+ {_PH} SELECT incident_key, lifecycle_state, last_seen FROM ph WHERE lifecycle_state IN ('new', 'observing', 'watch', 'alert') ORDER BY incident_key")
def active_phenomena(spark, d):
    return store.active_phenomena(_phenomena(spark, d)).select("incident_key", "lifecycle_state", "last_seen")


@query("SELECT 'ph:' || kind || ':' || subject AS phenomenon, count(*) AS n, max(ts) AS freshest FROM obs WHERE k % 5 <> 0 GROUP BY 1")
def phenomenon_groups(spark, d):
    """Unsuppressed detector rows by phenomenon."""
    return store.by_phenomenon(observations(spark, d).withColumn("suppressed", F.col("k") % 5 == 0))


@query("SELECT subject AS incident, count(DISTINCT (kind, k % 8)) AS contributions FROM obs GROUP BY subject")
def contribution_counts(spark, d):
    return store.contribution_counts(observations(spark, d).select(F.col("subject").alias("incident"), F.col("kind").alias("detector"), (F.col("k") % 8).alias("evidence_class")), "incident")


_NOW1 = NOW + DAY


@query(f"""+ {_PH}, i AS (SELECT count(*) FILTER (status = 'open' AND NOT suppressed AND lifecycle_state = 'watch' AND last_seen >= {_NOW1} - 7200) AS watch_open, count(*) FILTER (status = 'open' AND NOT suppressed AND lifecycle_state = 'alert' AND last_seen >= {_NOW1} - 7200) AS alert_open,
 count(*) FILTER (status = 'open' AND NOT suppressed AND lifecycle_state = 'watch') AS watch_total, count(*) FILTER (status = 'open' AND NOT suppressed AND lifecycle_state = 'alert') AS alert_total, count(*) FILTER (status = 'open' AND suppressed AND last_seen >= {_NOW1} - 7200) AS suppressed_open FROM ph)
SELECT i.*, (SELECT count(*) FROM obs WHERE ts >= {_NOW1} - 3600) AS events_last_hour, (SELECT max(ts) FROM obs WHERE kind = 'view') AS last_heartbeat_ts, (SELECT arg_max(k < 90, ts) FROM obs WHERE kind = 'view') AS last_heartbeat_ok FROM i""")
def status_inputs(spark, d):
    """All that a status is composed of in one row."""
    o = observations(spark, d)
    return store.status_inputs(_phenomena(spark, d), o, o.select(F.col("kind").alias("component"), "ts", (F.col("k") < 90).alias("ok")), _NOW1, 7200.0, "view")


@query(f"+ {_PH} SELECT incident_key, event_type, key FROM ph JOIN (SELECT DISTINCT subject AS entity_id, 'm' || subject AS key FROM obs) USING (entity_id) ORDER BY incident_key")
def incident_listing(spark, d):
    """Incidents with their entity, in report order."""
    return store.incident_rows(_phenomena(spark, d), _prints(spark, d)[0]).select("incident_key", "event_type", "key")


def _audit(spark, d):
    p = _phenomena(spark, d)
    s = F.col("entity_id")
    one = lambda kind, ts, rows: rows.select(F.lit(f"incident_{kind}").alias("event_type"), F.col(ts).alias("ts"))
    return one("opened", "first_seen", p).unionByName(one("reopened", "last_seen", p.where(s % 5 == 0))).unionByName(one("closed", "last_seen", p.where("status = 'closed'")))


@query(f"""+ {_PH}, au AS (SELECT 'opened' AS e, first_seen AS ts FROM ph UNION ALL SELECT 'reopened', last_seen FROM ph WHERE entity_id % 5 = 0 UNION ALL SELECT 'closed', last_seen FROM ph WHERE status = 'closed'),
dy AS (SELECT * FROM ph WHERE last_seen >= {NOW} AND last_seen < {_NOW1})
SELECT count(*) FILTER (e = 'opened' AND ts < {_NOW1} AND ts >= {NOW}) AS opened, count(*) FILTER (e = 'reopened' AND ts < {_NOW1} AND ts >= {NOW}) AS reopened, count(*) FILTER (e = 'closed' AND ts < {_NOW1} AND ts >= {NOW}) AS closed,
(SELECT count(*) FROM dy WHERE event_type LIKE 'ble_%') AS ble_hits, (SELECT count(*) FROM dy WHERE event_type LIKE 'deauth%') AS deauth_hits, (SELECT count(*) FROM dy WHERE event_type LIKE 'rogue%') AS rogue_hits,
(SELECT count(*) FROM (SELECT DISTINCT subject, k % 16 FROM obs)) AS fingerprint_links FROM au""")
def debrief_counts(spark, d):
    """The day's counts."""
    return reports.day_counts(_phenomena(spark, d), _audit(spark, d), _prints(spark, d)[1], NOW, _NOW1)


@query(f"SELECT subject, location_count, score FROM (SELECT subject, arg_max(ts, id) AS last_seen, arg_max(k, id) AS location_count, arg_max(value, id) AS score FROM obs WHERE kind = 'purchase' GROUP BY subject) WHERE last_seen >= {NOW} - 2 * {DAY} AND last_seen < {_NOW1} ORDER BY score DESC, subject LIMIT 10")
def debrief_cotravel(spark, d):
    """The strongest companions of a period."""
    return reports.top_cotravel(store.cotravel_upsert(_cotravel(spark, d), ["subject"]), NOW - 2 * DAY, _NOW1).select("subject", "location_count", "score")


def _queue(spark, d):
    k = F.col("k")
    return observations(spark, d).where("kind = 'error'").select("id", F.col("ts").alias("created_ts"), F.when(k % 3 == 0, "sent").otherwise("pending").alias("status"), (k % 7).alias("attempts"), F.lit(None).cast("double").alias("sent_ts"), F.lit(None).cast("double").alias("last_attempt"), k)


_QU = "qu AS (SELECT id, ts AS created_ts, CASE WHEN k % 3 = 0 THEN 'sent' ELSE 'pending' END AS status, k % 7 AS attempts, k FROM obs WHERE kind = 'error')"


@query(f"+ {_QU} SELECT id, created_ts, attempts FROM qu WHERE status = 'pending' ORDER BY created_ts, id LIMIT 20")
def push_pending(spark, d):
    return store.pending(_queue(spark, d)).select("id", "created_ts", "attempts")


@query(f"""+ {_QU}, hd AS (SELECT id AS h FROM qu WHERE status = 'pending' ORDER BY created_ts, id LIMIT 20)
SELECT id, CASE WHEN h IS NULL THEN status WHEN attempts >= 5 THEN 'failed' WHEN k % 2 = 0 THEN 'sent' ELSE status END AS status, attempts + CASE WHEN h IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN h IS NOT NULL AND attempts < 5 AND k % 2 = 0 THEN {NOW}::DOUBLE END AS sent_ts,
CASE WHEN h IS NOT NULL THEN {NOW}::DOUBLE END AS last_attempt FROM qu LEFT JOIN hd ON h = id""")
def push_flush(spark, d):
    """The queue after a pass: sent, waiting with one attempt more, or failed."""
    return store.flushed(_queue(spark, d), F.col("k") % 2 == 0, NOW).drop("k", "created_ts")


# ---- the operator's hand -----------------------------------------------------------------------------------------------------------------------------------


def _handled(spark, d):
    k = F.col("k")
    action = F.when(F.col("kind") != "signup", "evidence").when(k % 4 == 0, "resolved").when(k % 4 == 1, "false_positive").when(k % 4 == 2, "known_device").otherwise("archived")
    return control.dispositions(observations(spark, d).select("id", "subject", "ts", action.alias("action")), "subject")


_ST = "('resolved', 'false_positive', 'known_device')"
_HA = f"""hx AS (SELECT id, subject, ts, CASE WHEN kind <> 'signup' THEN 'evidence' WHEN k % 4 = 0 THEN 'resolved' WHEN k % 4 = 1 THEN 'false_positive' WHEN k % 4 = 2 THEN 'known_device' ELSE 'archived' END AS action FROM obs),
hn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts, id) AS nr FROM hx),
hr AS (SELECT id, subject, ts, nr, CASE WHEN action = 'evidence' THEN 'opened' ELSE 'unknown' END AS outcome, CASE WHEN action = 'evidence' THEN 'new' END AS state, 0::DOUBLE AS closed FROM hn WHERE nr = 1 UNION ALL
 SELECT id, subject, ts, nr, outcome, CASE outcome WHEN 'opened' THEN 'new' WHEN 'reopened' THEN 'new' WHEN 'disposed' THEN action ELSE ps END, CASE outcome WHEN 'disposed' THEN ts ELSE pc END FROM (
  SELECT n.id, n.subject, n.ts, n.nr, n.action, r.state AS ps, r.closed AS pc, CASE WHEN n.action = 'evidence' THEN CASE WHEN r.state IS NULL THEN 'opened' WHEN r.state NOT IN {_ST} THEN 'touched' WHEN n.ts - r.closed < CASE r.state WHEN 'resolved' THEN 0 ELSE 604800 END THEN 'noted' ELSE 'reopened' END
   WHEN r.state IS NULL THEN 'unknown' WHEN r.state IN {_ST} OR n.action NOT IN {_ST} OR n.action = 'resolved' AND r.state = 'new' THEN 'invalid' ELSE 'disposed' END AS outcome
  FROM hr r JOIN hn n ON n.subject = r.subject AND n.nr = r.nr + 1)),
mv AS (SELECT * FROM (SELECT id, subject, ts, lag(state) OVER (PARTITION BY subject ORDER BY ts, id) AS from_state, state AS to_state FROM hr WHERE state IS NOT NULL) WHERE from_state IS NULL OR from_state <> to_state)"""


@query(f"WITH RECURSIVE {OBS}, {_HA} SELECT id, subject, outcome, state FROM hr", obs=False)
def disposition_outcomes(spark, d):
    """Find or create, dispositions, notes inside reopening windows, reopening behind them."""
    return _handled(spark, d).select("id", "subject", "outcome", "state")


def _moves(spark, d):
    return control.timeline(_handled(spark, d).where("state is not null"), "subject", ["ts", "id"])


@query(f"WITH RECURSIVE {OBS}, {_HA} SELECT id, subject, ts, from_state, to_state FROM mv", obs=False)
def incident_timeline(spark, d):
    """The moves of every incident."""
    return _moves(spark, d).select("id", "subject", "ts", "from_state", "to_state")


@query(f"""WITH RECURSIVE {OBS}, {_HA} SELECT subject, arg_max(to_state, (ts, id)) AS state, 'info' AS severity, CASE WHEN arg_max(to_state, (ts, id)) IN {_ST} THEN 'closed' ELSE 'open' END AS status, CASE WHEN arg_max(to_state, (ts, id)) IN {_ST} THEN arg_max(ts, (ts, id)) END AS closed_at FROM mv GROUP BY subject""", obs=False)
def applied_transitions(spark, d):
    """The incident rows that the moves leave."""
    return control.applied(_moves(spark, d), "subject", ["ts", "id"])[0]


@query(f"WITH RECURSIVE {OBS}, {_HA} SELECT subject, ts, CASE WHEN from_state IS NULL THEN 'incident_opened' WHEN from_state IN {_ST} THEN 'incident_reopened' ELSE 'incident_closed' END AS event_type FROM mv", obs=False)
def transition_events(spark, d):
    """The audit events of the moves."""
    return control.applied(_moves(spark, d), "subject", ["ts", "id"])[1]


_MOVES = list(control.ALLOWED)
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, bs in control.ALLOWED.items() for b in bs)


@query(f"SELECT DISTINCT from_state, to_state, (from_state, to_state) IN ({_PAIRS}) AS valid FROM (SELECT {_MOVES}[k % 8 + 1] AS from_state, {_MOVES}[id % 8 + 1] AS to_state FROM obs)")
def transition_validation(spark, d):
    """Which moves between the eight states are allowed."""
    return control.validated(observations(spark, d).select(_pick(_MOVES, F.col("k") % 8).alias("from_state"), _pick(_MOVES, F.col("id") % 8).alias("to_state")).distinct())


# ---- evidence ------------------------------------------------------------------------------------------------------------------------------------------------


@query("""SELECT id, concat_ws('; ', CASE k % 3 WHEN 0 THEN 'MAC reappeared in ' || k || ' minute window' WHEN 1 THEN 'SSID probe repeated in ' || k || ' minute window' ELSE 'Event ' || kind || ' in window ' || k END, 'severity=watch', CASE WHEN k > 1 THEN 'observed ' || k || ' times this session open' END,
CASE WHEN k % 4 <> 0 THEN 'place=p' || (k % 4) END, CASE WHEN k % 5 = 0 THEN 'entity is on baseline for this place' END, CASE WHEN k % 6 = 0 THEN 'suppressed from threat score (baseline/ignore)' END) AS line, printf('%08x', (('0x' || substr(sha1(subject::VARCHAR), 1, 8))::BIGINT % 4294967295)) AS subject_fp FROM obs""")
def match_evidence(spark, d):
    """Reasons and subject mark of each window match (P20)."""
    k = F.col("k")
    kind = F.when(k % 3 == 0, "mac_reappear").when(k % 3 == 1, "ssid_probe_repeat").otherwise(F.col("kind"))
    r = reports.match_reasons(kind, k.cast("string"), F.lit("watch"), k, F.when(k % 4 != 0, F.concat(F.lit("p"), (k % 4).cast("string"))), k % 5 == 0, k % 6 == 0)
    return observations(spark, d).select("id", F.array_join(r, "; ").alias("line"), reports.subject_mark(F.col("subject").cast("string")).alias("subject_fp"))


def _results(spark, d):
    line = lambda n: F.struct(F.lit("copresence").alias("kind"), F.concat(F.lit(f"{n} "), F.col("kind")).alias("detail"), F.lit(0.25).alias("weight"), F.array("id").alias("obs_ids"))
    return observations(spark, d).select(F.lit("gps").alias("detector"), F.lit("cotravel").alias("kind"), F.col("subject").cast("string").alias("subject"), F.lit("watch").alias("severity"), F.col("ts").alias("observed_at"), F.concat(F.lit("seen with "), F.col("subject").cast("string")).alias("summary"), F.array(line(1), line(2)).alias("lines"), "id", "k")


@query("""SELECT subject::VARCHAR AS subject, 'cotravel' AS event_type, ts AS observed_at, 'seen with ' || subject AS summary, '1 ' || kind || '|2 ' || kind AS reasons, 2::BIGINT AS n FROM obs""")
def incident_fields(spark, d):
    """Detection results as incident fields, the evidence read back from its JSON."""
    f = reports.incident_fields(_results(spark, d))
    e = F.from_json("evidence_json", "struct<kind:string,reasons:array<string>,evidence_lines:array<struct<detail:string>>>")
    return f.select("subject", "event_type", "observed_at", "summary", F.array_join(e["reasons"], "|").alias("reasons"), F.size(e["evidence_lines"]).cast("long").alias("n"))


@query("""SELECT id, CASE WHEN k % 3 = 0 THEN 'cotravel:0.0' ELSE 'copresence:0.25' END AS why, CASE WHEN k % 3 = 1 THEN 'density:-0.06' ELSE '' END AS against, CASE WHEN k % 3 = 0 THEN id::VARCHAR ELSE '' END AS obs_ids FROM obs""")
def evidence_lines(spark, d):
    """Lines read back from stored evidence, with the fallback for rows that have no block."""
    k = F.col("k")
    line = lambda kind, w: F.struct(F.lit(kind).alias("kind"), F.lit("x").alias("detail"), F.lit(w).alias("weight"))
    block = F.struct(F.array(line("copresence", 0.25)).alias("why"), F.when(k % 3 == 1, F.array(line("density", 0.06))).alias("against"))
    rows = observations(spark, d).select("id", F.lit("cotravel").alias("event_type"), F.lit("s").alias("summary"), F.when(k % 3 == 0, F.to_json(F.struct(F.array("id").alias("obs_ids")))).otherwise(F.to_json(F.struct(block.alias("fusion")))).alias("evidence_json"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["kind"], F.lit(":"), x["weight"].cast("string"))), ",")
    return reports.evidence_lines(rows).select("id", said("why").alias("why"), said("against").alias("against"), F.array_join(F.transform(F.flatten(F.transform("why", lambda x: x["obs_ids"])), lambda x: x.cast("string")), ",").alias("obs_ids"))


@query()
def explained_blocks(spark, d):
    """The text of each subject's assessment (I11, T6): tested against a plain loop."""
    ev = catalog._evidence(spark, d, detector=True)
    f = catalog.fuse_by_subject(spark, d)
    return reports.explained(ev.join(f, "subject"), ["subject"])


# ---- scans and texts -------------------------------------------------------------------------------------------------------------------------------------------


def _devices(spark, d):
    """Observations as capture devices with nested JSON."""
    k = F.col("k")
    client = F.map_from_arrays(F.array(F.concat(F.lit("ap"), (k % 5).cast("string"))), F.array(F.struct((k * 2).alias("dot11.client.retries"), (k + 40).alias("dot11.client.tx_packets"))))
    net = lambda name: F.struct(name.alias("dot11.advertisedssid.ssid"))
    dot11 = F.struct(client.alias("dot11.device.client_map"), F.array(net(F.concat(F.lit("net"), (k % 3).cast("string"))), net(F.lit(""))).alias("dot11.device.advertised_ssid_map"), F.map_from_arrays(F.array(F.lit("1")), F.array(net(F.concat(F.lit("net"), (k % 2).cast("string"))))).alias("dot11.device.responded_ssid_map"))
    blob = F.to_json(F.struct(dot11.alias("dot11.device"), F.when(k % 2 == 0, F.lit("6")).alias("kismet.device.base.channel"), F.lit(5180000.0).alias("kismet.device.base.frequency"), F.when(k % 7 == 0, F.lit(1)).alias("btle.device")))
    return observations(spark, d).select("id", F.concat(F.lit("m"), F.col("subject").cast("string")).alias("devmac"), F.when(k % 3 == 0, "BTLE Device").otherwise("Wi-Fi AP").alias("type"), blob.alias("device"), F.col("ts").alias("last_time"))


@query("SELECT 'M' || subject AS target, 'AP' || (k % 5) AS source, count(*) AS n, max(k * 2)::DOUBLE AS retries FROM obs WHERE k * 2 > 50 AND (k * 2)::DOUBLE / (k + 40) > 0.5 GROUP BY ALL")
def retry_events(spark, d):
    """Clients with suspicious retries, from the devices' client maps."""
    return normalize.retry_events(_devices(spark, d)).groupBy("target", "source").agg(F.count("*").alias("n"), F.max("retries").alias("retries"))


@query("SELECT id, 'M' || subject AS bssid, array_to_string(list_sort(list_distinct(['net' || (k % 3), 'net' || (k % 2)])), ',') AS ssids, CASE WHEN k % 2 = 0 THEN 6 ELSE 36 END AS channel FROM obs")
def network_sets(spark, d):
    """Advertised and responded networks as one set, and the channel, by frequency where none is named."""
    n = normalize.network_sets(_devices(spark, d).withColumn("devmac", F.concat_ws("/", "devmac", F.col("id").cast("string"))))
    both = _devices(spark, d).select("id", normalize.normalize_mac("devmac").alias("bssid"), F.col("last_time").alias("ts"))
    return both.join(n.distinct(), ["bssid", "ts"]).select("id", "bssid", F.array_join("ssids", ",").alias("ssids"), "channel")


@query("SELECT k % 3 = 0 OR k % 7 = 0 AS ble, count(*) AS n FROM obs GROUP BY 1")
def ble_devices(spark, d):
    """Bluetooth devices by type, or by a key of their metadata."""
    return _devices(spark, d).groupBy(normalize.is_ble(F.col("type"), F.col("device")).alias("ble")).agg(F.count("*").alias("n"))


_AP_WORDS = ["APSPOOF", "BSSTIMESTAMP", "PROBECHAN", "DEAUTHFLOOD", "CRYPTODROP", "OTHER"]


@query(f"SELECT id AS ts, '[Kismet Alert: ' || {_AP_WORDS}[k % 6 + 1] || ']' AS ssid, CASE WHEN k % 2 = 0 THEN 'AA' ELSE 'UNKNOWN' END AS rogue_bssid, 'HIGH' AS severity, 'Kismet alert: ' || CASE WHEN k % 12 = 11 THEN 'wmmtspec seen' ELSE {_AP_WORDS}[k % 6 + 1] END AS reason FROM (SELECT id::DOUBLE AS id, k FROM obs) WHERE k % 6 NOT IN (3, 5) OR k % 12 = 11")
def ap_alerts(spark, d):
    """Alerts that speak of access points, by keywords of header and text."""
    k = F.col("k")
    blob = F.to_json(F.struct(F.when(k % 12 == 11, "wmmtspec seen").alias("kismet.alert.text"), F.when(k % 2 == 0, "aa").alias("kismet.alert.source_mac")))
    return normalize.ap_alerts(observations(spark, d).select(F.col("id").cast("double").alias("ts_sec"), _pick(_AP_WORDS, k % 6).alias("header"), blob.alias("json")))


@query("SELECT source || '|' || lang AS name, length(trim(regexp_replace(source || ' <b>(select) ' || lang || ' DROP; ', '[<>\"''&;|`$(){}\\[\\]]|select|SELECT|drop|DROP', '', 'g'))) AS n, count(*) AS docs FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL", obs=False)
def sanitized_text(spark, d):
    """Texts without dangerous characters and words of SQL (X11)."""
    t = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    clean = C.sanitize(F.concat("source", F.lit(" <b>(select) "), "lang", F.lit(" DROP; ")))
    return t.groupBy(F.concat_ws("|", "source", "lang").alias("name"), F.length(clean).cast("long").alias("n")).agg(F.count("*").alias("docs"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '>', '&gt;'), '<', '&lt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM documents", obs=False)
def escape_cdata(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(C.escape_cdata("text")).alias("escaped"))


@query("SELECT id, CASE WHEN k % 2 = 0 THEN 'OSError: cannot open <path>: <mac>' ELSE 'OSError: lock in <path>' END AS text FROM obs")
def error_texts(spark, d):
    """Failures without device addresses and paths."""
    m = F.when(F.col("k") % 2 == 0, "cannot  open /home/u/x.db: aa:bb:cc:dd:ee:0f").otherwise(F.concat(F.lit("lock in /var/run/"), F.col("id").cast("string")))
    return observations(spark, d).select("id", C.error_text(F.lit("OSError"), m).alias("text"))


_TRIED = ["aa:bb:cc:dd:ee:ff", "AA-BB-CC-DD-EE-0F", "aa:bb", "my net", "x<y", "../etc", "ok.txt", ".hidden", "a/b", '{"a": 1}', "{", ""]


@query("""SELECT v AS value, regexp_full_match(v, '([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}') AS mac, length(v) BETWEEN 1 AND 32 AND NOT regexp_matches(v, '[<>"''&;|`$(){}\\[\\]]') AS ssid, NOT contains(v, '..') AND NOT contains(v, '~') AND NOT regexp_matches(v, '[<>|&;`]') AS path,
NOT starts_with(v, '.') AND regexp_full_match(v, '[a-zA-Z0-9._\\-]+') AS filename, coalesce(json_valid(v) AND v <> '', false) AS json FROM (SELECT DISTINCT """ + "[" + ", ".join("'" + x + "'" for x in _TRIED) + """][k % 12 + 1] AS v FROM obs)""")
def validations(spark, d):
    """Which inputs pass as an address, a network's name, a path, a file name, JSON."""
    v = observations(spark, d).select(_pick(_TRIED, F.col("k") % 12).alias("value")).distinct()
    return v.select("value", C.valid_mac("value").alias("mac"), C.valid_ssid("value").alias("ssid"), C.valid_path("value").alias("path"), C.valid_filename("value").alias("filename"), C.valid_json("value").alias("json"))


@query("SELECT subject, true AS marked, 'm' || subject AS opened FROM (SELECT DISTINCT subject FROM obs)")
def sealed_fields(spark, d):
    """Sealed and opened again: every field comes back."""
    key = F.lit("0123456789abcdef")
    s = observations(spark, d).select("subject").distinct().withColumn("s", C.sealed(F.concat(F.lit("m"), F.col("subject").cast("string")), key))
    return s.select("subject", F.startswith("s", F.lit("enc:v1:")).alias("marked"), C.opened("s", key).alias("opened"))


@query("SELECT id, 'aa:bb:xx:xx:xx:0f saw b x' AS text, 'ssid(len=' || length('net' || k) || ',h=' || substr(sha1('net' || k), 1, 4) || ')' AS name FROM obs")
def redacted_json(spark, d):
    """Evidence objects redacted at any depth."""
    blob = F.to_json(F.struct(F.array(F.struct(F.lit("aa:bb:cc:dd:ee:0f saw <b> [x]").alias("text"), F.concat(F.lit("net"), F.col("k").cast("string")).alias("ssid"))).alias("lines"), F.col("k").alias("k")))
    r = normalize.redact_json(observations(spark, d).select("id", blob.alias("j")), "j")
    e = F.from_json("j", "struct<lines:array<struct<text:string,ssid:string>>>")["lines"][0]
    return r.select("id", e["text"].alias("text"), e["ssid"].alias("name"))


# ---- ingest, time, paths ---------------------------------------------------------------------------------------------------------------------------------------


_CLOCKS = [NOW - 3 * DAY, NOW - 2 * DAY, NOW - DAY, NOW - DAY + 60, NOW]


@query(f"""WITH RECURSIVE {OBS}, ck AS (SELECT unnest(range(0, 5))::INTEGER AS cycle, unnest({_CLOCKS})::DOUBLE AS now), st AS (
 SELECT cycle, start, (SELECT max(ts) + 1 FROM obs WHERE ts BETWEEN start AND now) AS watermark, (SELECT count(*) FROM obs WHERE ts BETWEEN start AND now) AS n FROM (SELECT cycle, now, greatest(0, now - 90000) AS start FROM ck WHERE cycle = 0) UNION ALL
 SELECT cycle, start, coalesce((SELECT max(ts) + 1 FROM obs WHERE ts BETWEEN start AND now), wm), (SELECT count(*) FROM obs WHERE ts BETWEEN start AND now) FROM (SELECT ck.cycle, ck.now, st.watermark AS wm, greatest(CASE WHEN st.watermark <= ck.now + 300 THEN st.watermark ELSE 0 END, ck.now - 90000, 0) AS start FROM st JOIN ck ON ck.cycle = st.cycle + 1))
SELECT * FROM st""", obs=False)
def ingest_cycles(spark, d):
    """Five cycles of watermarked scans with a bounded catch-up (S8, S9, M2, M3); ingest.ingest commits rows and watermark together (K2)."""
    return ingest.cycles(observations(spark, d), "ts", _CLOCKS, 90000.0)


@query("SELECT k, CASE WHEN k % 5 IN (0, 1) THEN NULL WHEN k % 5 = 2 THEN k::DOUBLE ELSE NULL END AS watermark FROM (SELECT DISTINCT k FROM obs WHERE k > 0)")
def watermark_parse(spark, d):
    """Stored watermarks that are numbers above zero."""
    k = F.col("k")
    raw = F.when(k % 5 == 0, "soon").when(k % 5 == 1, F.concat(F.lit("-"), k.cast("string"))).when(k % 5 == 2, k.cast("string")).when(k % 5 == 3, "nan")
    return observations(spark, d).where("k > 0").select("k").distinct().select("k", ingest.parse_watermark(raw).alias("watermark"))


@query(f"+ {_DE} SELECT target, day::INTEGER AS day, count(*) AS held FROM (SELECT target, ts, unnest(range(0, 30)) AS day FROM de) WHERE ts <= {NOW} - day * {DAY} AND ts > {NOW} - day * {DAY} - 3 * {DAY} GROUP BY ALL")
def event_memory(spark, d):
    """What a memory of three days holds at each day's clock."""
    return windows.held_events(deauths(spark, d), "ts", NOW, DAY, 30, 3 * DAY).groupBy("target", F.col("clock").alias("day")).agg(F.count("*").alias("held"))


@query("SELECT id, ts, subject, lat, lon FROM obs WHERE k % 3 <> 0")
def located_sightings(spark, d):
    """Sightings with a place."""
    o = observations(spark, d)
    return geo.sightings(o.withColumns({c: F.when(F.col("k") % 3 != 0, F.col(c)) for c in ("lat", "lon")})).select("id", "ts", "subject", "lat", "lon")


def _fixes(spark, d):
    o = observations(spark, d)
    return geo.best_fixes(o, F.floor(F.col("ts") / 21600)).withColumn("registry", F.lit("operator"))


_FI = "fi AS (SELECT floor(ts / 21600)::BIGINT AS cycle, max(ts) AS ts, arg_max(id, (ts, -id)) AS id, arg_max(k, (ts, -id)) AS k FROM obs GROUP BY 1)"


@query(f"+ {_FI} SELECT cycle, ts, id FROM (SELECT *, lag(k) OVER (ORDER BY ts, id) AS p FROM fi) WHERE p IS NULL OR p <> k")
def operator_path(spark, d):
    """The operator's newest fix of each cycle, and where the place changes."""
    return geo.operator_path(_fixes(spark, d)).select("cycle", "ts", "id")


@query()
def place_registry(spark, d):
    """Places of each subject's points with a memory of three (G6): tested against a plain loop."""
    o = observations(spark, d).withColumnRenamed("subject", "registry").select("registry", "ts", "id", "lat", "lon")
    return geo.place_registry(o, most=3)


@query(f"""+ cu AS (SELECT DISTINCT subject AS key, k AS ssid, k % 16 AS fp FROM obs WHERE ts >= {NOW}), pf AS (SELECT DISTINCT subject AS key, k % 16 AS fp FROM obs),
pp AS (SELECT a.key AS key_a, b.key AS key_b, true AS n, false AS f FROM cu a JOIN cu b ON a.ssid = b.ssid AND a.key < b.key UNION ALL SELECT least(a.key, b.key), greatest(a.key, b.key), false, true FROM cu a JOIN pf b ON a.fp = b.fp AND a.key <> b.key)
SELECT key_a, key_b, bool_or(n) AS by_name, bool_or(f) AS by_fingerprint FROM pp GROUP BY ALL""")
def identity_cycle_pairs(spark, d):
    """The pairs that one cycle of the fingerprint engine scores."""
    o = observations(spark, d).select(F.col("subject").alias("key"), F.col("k").alias("ssid"), (F.col("k") % 16).alias("fingerprint"), "ts")
    return identity.cycle_pairs(o.where(F.col("ts") >= NOW), o)


@query(f"""+ v AS (SELECT subject AS key, min(ts) AS a, max(ts) AS b, count(*) AS n FROM obs WHERE ts >= {NOW} GROUP BY 1), h AS (SELECT subject AS key, min(ts) AS lo, max(ts) AS hi, count(*) AS c, count(DISTINCT (round(lat, 6), round(lon, 6))) AS places FROM obs GROUP BY 1)
SELECT key, least(a, lo) AS first_ts, greatest(b, hi) AS last_ts, greatest(n, c) AS n, places FROM v JOIN h USING (key)""")
def view_history(spark, d):
    """A cycle's views widened by all that is stored of them (H5)."""
    o = observations(spark, d)
    v = o.where(F.col("ts") >= NOW).groupBy(F.col("subject").alias("key")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return identity.with_history(v, o, "subject").select("key", "first_ts", "last_ts", "n", F.size("locations").cast("long").alias("places"))


# ---- whole captures --------------------------------------------------------------------------------------------------------------------------------------------


def _legacy_devices(spark, d):
    k = F.col("k")
    return observations(spark, d).select("id", F.concat(F.lit("m"), F.col("subject").cast("string")).alias("devmac"), "kind", F.when(k % 10 != 0, F.col("ts")).otherwise(0.0).alias("last_time"), F.lit("x").alias("type"), F.when(k % 4 != 0, F.col("lat")).otherwise(0.0).alias("avg_lat"), F.col("lon").alias("avg_lon"), F.col("ts").alias("first_time"), k)


@query("SELECT 'M' || subject AS subject, count(*) AS n, min(ts) AS first_ts FROM obs WHERE k % 10 <> 0 GROUP BY 1")
def legacy_appearances(spark, d):
    """Every device with a time."""
    return legacy.appearances(_legacy_devices(spark, d)).groupBy("subject").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("SELECT DISTINCT lat, lon, ts FROM obs WHERE k % 4 <> 0")
def legacy_gps_points(spark, d):
    return legacy.gps_points(_legacy_devices(spark, d))


@query("SELECT id, subject, last_value(CASE WHEN kind = 'signup' THEN 's' || k END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY ts, kind <> 'signup' ROWS UNBOUNDED PRECEDING) AS place, kind FROM obs QUALIFY kind <> 'signup'")
def legacy_placed(spark, d):
    """Appearances with the session that was running."""
    o = observations(spark, d)
    sessions = o.where("kind = 'signup'").select("subject", F.col("ts").alias("start_ts"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("place"))
    return legacy.with_place(o.where("kind <> 'signup'").select("id", "subject", "ts", "kind"), sessions, ["subject"]).select("id", "subject", "place", "kind")


@query("SELECT k, array_to_string(list_sort(list(DISTINCT subject)), ',') AS subjects FROM obs GROUP BY k")
def legacy_devices_by_place(spark, d):
    g = legacy.devices_by_place(observations(spark, d), "k")
    return g.select("k", F.array_join(F.transform("subjects", lambda x: x.cast("string")), ",").alias("subjects"))


@query("SELECT subject, array_to_string(list_sort(list(DISTINCT k)), ',') AS places FROM obs WHERE kind = 'error' GROUP BY subject HAVING count(DISTINCT k) >= 2")
def legacy_multi_place(spark, d):
    """Subjects seen at several places, with the places."""
    m = legacy.multi_place(observations(spark, d).where("kind = 'error'"), "k")
    return m.select("subject", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


@query("""+ se AS (SELECT k, min(ts) AS start_ts, min(lat) AS lat, min(lon) AS lon FROM obs GROUP BY k), sk AS (SELECT DISTINCT subject, k FROM obs WHERE kind = 'error'), sv AS (SELECT subject FROM sk GROUP BY subject HAVING count(*) > 1)
SELECT subject, array_to_string(list(k::VARCHAR ORDER BY start_ts), ',') AS path, count(*) AS n FROM sk JOIN se USING (k) WHERE subject IN (SELECT subject FROM sv) GROUP BY subject""")
def legacy_tracks(spark, d):
    """Time-ordered paths of subjects seen at several places."""
    o = observations(spark, d)
    sessions = o.groupBy("k").agg(F.min("ts").alias("start_ts"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    t = legacy.tracks(sessions, o.where("kind = 'error'"), "k")
    place = lambda p: (F.round((p["lat"] - 33.4) / 0.01).cast("int") % 10 + F.round((-112.0 - p["lon"]) / 0.01).cast("int") * 10).cast("string")
    return t.select("subject", F.array_join(F.transform("path", place), ",").alias("path"), F.size("path").cast("long").alias("n"))


@query(f"SELECT subject, CASE WHEN work_ratio > 0.7 THEN 'work' WHEN off_ratio > 0.7 THEN 'off' END AS track, regular FROM ({ORACLES['legacy_temporal']})", obs=False)
def legacy_time_groups(spark, d):
    """The track that a subject is drawn on."""
    return legacy.time_groups(legacy_stats.temporal(observations(spark, d)))


@query("SELECT n_name AS name, true AS point, 37::BIGINT AS ring FROM nation", obs=False)
def kml_placemarks(spark, d):
    """Places as KML: a point and a ring of 37."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.lit(33.4) + F.col("n_nationkey") * 0.01).alias("lat"), F.lit(-112.0).alias("lon"), F.lit(100.0).alias("radius"), F.lit("a & <b>").alias("note"))
    p = legacy.placemarks(n)
    ring = F.regexp_extract("kml", "<LinearRing><coordinates>([^<]*)", 1)
    return p.select("name", F.contains("kml", F.lit("<description>a &amp; &lt;b&gt;</description>")).alias("point"), F.size(F.split(ring, " ")).cast("long").alias("ring"))


@query(f"SELECT '- **' || severity || '** ' || target || ' from ' || source || ': ' || n || ' frames' AS line FROM ({ORACLES['deauth_severity']})", obs=False)
def attack_report_lines(spark, d):
    """The lines of the attack report."""
    return reports.attack_lines(catalog.deauth_severity(spark, d)).select("line")
