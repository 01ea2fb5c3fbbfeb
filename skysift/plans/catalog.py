"""Registry of the library's own queries on the sample tables, and the equal DuckDB queries.

The sample tables hold no radio captures; skysift.sources.bindings says how they stand in. A slot is a day here, not five minutes, as a subject has
about two events a day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysift.functions import columns as C
from skysift.operators import geo, identity, incidents, legacy_stats, radio, upserts, windows
from skysift.sources import sinks
from skysift.sources.bindings import OBS, observations, table

DAY = 86400.0
#: The injected clock: the end of the sample's thirty days, in epoch seconds.
NOW = 1706572800.0
OPERATOR = 0
PLACES = [("home", 33.4, -112.0, 30.0, 0, 24), ("office", 33.41, -112.01, 30.0, 8, 18), ("gym", 33.43, -112.02, 30.0, 17, 22)]
IGNORED = [1, 4, 7]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, obs: bool = True):
    """Registers a query under its function's name, with its oracle; `obs` puts the bound view before it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {OBS}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if obs else sql
        return f

    return put


def ignored(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i,) for i in IGNORED], "subject long")


# ---- re-appearance -------------------------------------------------------------------------------------------------------------------------------


@query(f"""+ s AS (SELECT subject, floor(ts / {DAY}) AS slot, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM obs WHERE subject NOT IN (1, 4, 7) GROUP BY ALL)
SELECT a.subject, CASE back WHEN 1 THEN '5-10' WHEN 2 THEN '10-15' ELSE '15-20' END AS label, sum(a.n)::BIGINT AS n, min(a.lo) AS first_ts, max(a.hi) AS last_ts,
  CASE back WHEN 3 THEN 'alert' ELSE 'watch' END AS severity
FROM s a JOIN (SELECT *, unnest([1, 2, 3]) AS back FROM s) b ON a.subject = b.subject AND a.slot = b.slot + b.back GROUP BY a.subject, back""")
def window_reappearance(spark, d):
    """Subjects seen in a slot and in one of the three before it."""
    return windows.reappearances(windows.ignore(observations(spark, d), ignored(spark), "subject"), DAY)


@query(f"""+ s AS (SELECT k AS ssid, floor(ts / {DAY}) AS slot, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM obs WHERE kind = 'view' GROUP BY ALL)
SELECT a.ssid, CASE back WHEN 1 THEN '5-10' WHEN 2 THEN '10-15' ELSE '15-20' END AS label, sum(a.n)::BIGINT AS n, min(a.lo) AS first_ts, max(a.hi) AS last_ts,
  CASE back WHEN 3 THEN 'alert' ELSE 'watch' END AS severity
FROM s a JOIN (SELECT *, unnest([1, 2, 3]) AS back FROM s) b ON a.ssid = b.ssid AND a.slot = b.slot + b.back GROUP BY a.ssid, back""")
def ssid_probe_repeat(spark, d):
    return windows.reappearances(observations(spark, d).where("kind = 'view'").withColumnRenamed("k", "ssid"), DAY, "ssid")


@query("SELECT kind, count(*) AS n, count(DISTINCT subject) AS subjects FROM obs WHERE subject NOT IN (1, 4, 7) GROUP BY kind")
def ignore_list_antijoin(spark, d):
    o = windows.ignore(observations(spark, d), ignored(spark), "subject")
    return o.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"))


@query(f"SELECT max(ts) AS max_last_time, count(*) FILTER (ts >= {NOW} - 7200) AS recent, {NOW} - max(ts) AS age_s, {NOW} - max(ts) > 180 AS deaf FROM obs")
def capture_freshness(spark, d):
    a = observations(spark, d).agg(F.max("ts").alias("max_last_time"), F.count_if(F.col("ts") >= NOW - 7200).alias("recent"))
    return a.withColumn("age_s", NOW - F.col("max_last_time")).withColumn("deaf", F.coalesce(F.col("age_s") > 180, F.lit(True)))


@query(f"SELECT id, ts, subject, kind FROM obs WHERE subject < 50 AND kind = 'error' AND ts BETWEEN {NOW} - 20 * {DAY} AND {NOW} ORDER BY ts, id LIMIT 100")
def observation_filter_topn(spark, d):
    o = observations(spark, d).where((F.col("subject") < 50) & (F.col("kind") == "error") & F.col("ts").between(NOW - 20 * DAY, NOW))
    return o.orderBy("ts", "id").limit(100).select("id", "ts", "subject", "kind")


_HEADERS = ["DEAUTH", "DISASSOCTRAFFIC", "DEAUTHENTICATION", "DISASSOCIATION", "DEAUTHFLOOD", "BSSFLOOD", "APSPOOF", "CHANGEHOSTNAME", "PROBECHAN", "BEACONCHANGE", "NULLPROBERESP", "ADHOCCONFLICT"]


@query(f"SELECT {_HEADERS}[k % 12 + 1] AS header, CASE WHEN k % 12 < 8 THEN 'deauth_alert' ELSE 'kismet_alert' END AS obs_kind, count(*) AS n, min(ts) AS first_ts FROM obs GROUP BY ALL")
def normalize_alert_kind(spark, d):
    header = F.get(F.array(*(F.lit(h) for h in _HEADERS)), F.col("k") % 12)
    o = observations(spark, d).withColumn("header", header)
    kind = F.when(C.contains_any("header", C.DEAUTH_KEYWORDS), "deauth_alert").otherwise("kismet_alert")
    return o.groupBy("header", kind.alias("obs_kind")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, sum(CASE WHEN json_extract_string(props, '$.zz') IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing FROM events GROUP BY 1", obs=False)
def json_path_extract(spark, d):
    v = F.try_parse_json("props")
    e = table(spark, d, "events").select(F.try_variant_get(v, "$.k", "int").alias("k"), F.try_variant_get(v, "$.zz", "string").alias("zz"))
    return e.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.when(F.col("zz").isNull(), 1).otherwise(0)).alias("missing"))


@query("""SELECT source, count(*) AS n FROM (SELECT CASE WHEN k % 3 = 0 THEN 'location' WHEN k % 3 = 1 THEN 'device' ELSE 'row' END AS source FROM obs WHERE abs(lat) >= 1e-4 AND abs(lon) >= 1e-4) GROUP BY 1""")
def gps_coalesce_chain(spark, d):
    o = observations(spark, d).where((F.abs("lat") >= 1e-4) & (F.abs("lon") >= 1e-4))
    a, b = F.when(F.col("k") % 3 == 0, "location"), F.when(F.col("k") % 3 == 1, "device")
    return o.groupBy(C.first_of(a, b, F.lit("row")).alias("source")).agg(F.count("*").alias("n"))


@query(f"SELECT subject, max(ts) AS last_ts, arg_max(kind, (ts, id)) AS kind FROM obs WHERE ts <= {NOW} - 10 * {DAY} GROUP BY subject")
def asof_snapshot(spark, d):
    o = observations(spark, d).where(F.col("ts") <= NOW - 10 * DAY)
    return o.groupBy("subject").agg(F.max("ts").alias("last_ts"), F.max_by("kind", F.struct("ts", "id")).alias("kind"))


@query("SELECT id, subject, last_value(CASE WHEN kind = 'signup' THEN ts END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stamp FROM obs")
def timestamp_carry_forward(spark, d):
    o = observations(spark, d).withColumn("own", F.when(F.col("kind") == "signup", F.col("ts")))
    return windows.carried_forward(o, ["subject"], ["ts", "id"], "own", "stamp").select("id", "subject", "stamp")


# ---- baselines -----------------------------------------------------------------------------------------------------------------------------------


@query("""+ r AS (SELECT *, row_number() OVER (PARTITION BY k, subject ORDER BY ts, id) AS nr FROM obs)
SELECT k AS place, subject, count(*) AS sightings, min(ts) AS first_seen, max(ts) AS last_seen, min(ts) FILTER (nr = 3) AS learned_ts FROM r GROUP BY k, subject""")
def baseline_learning(spark, d):
    r = windows.running_count(observations(spark, d), ["k", "subject"], ["ts", "id"], "nr")
    return r.groupBy(F.col("k").alias("place"), "subject").agg(F.count("*").alias("sightings"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min(F.when(F.col("nr") == 3, F.col("ts"))).alias("learned_ts"))


@query("""+ r AS (SELECT *, row_number() OVER (PARTITION BY k, subject ORDER BY ts, id) AS nr FROM obs)
SELECT subject, count(*) FILTER (nr < 3) AS filed, count(*) FILTER (nr >= 3) AS suppressed FROM r GROUP BY subject""")
def baseline_suppression(spark, d):
    """The sighting is counted before the test, so the third match is itself suppressed."""
    r = windows.running_count(observations(spark, d), ["k", "subject"], ["ts", "id"], "nr")
    return r.groupBy("subject").agg(F.count_if(F.col("nr") < 3).alias("filed"), F.count_if(F.col("nr") >= 3).alias("suppressed"))


_DIST = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


@query(f"""+ p(name, la, lo, o, h0, h1) AS (VALUES ('home', 33.4::DOUBLE, -112.0::DOUBLE, 0, 0, 24), ('office', 33.41::DOUBLE, -112.01::DOUBLE, 1, 8, 18), ('gym', 33.43::DOUBLE, -112.02::DOUBLE, 2, 17, 22)),
m AS (SELECT id, name, o, {_DIST.format(a='lat', b='la', c='lon', d='lo')} AS dist FROM obs, p WHERE floor((floor(ts)::BIGINT % 86400) / 3600) >= h0 AND floor((floor(ts)::BIGINT % 86400) / 3600) < h1),
b AS (SELECT id, arg_min(name, (dist, o)) AS place FROM m WHERE dist <= 30 GROUP BY id)
SELECT place, count(*) AS n FROM obs LEFT JOIN b USING (id) GROUP BY place""")
def place_geofence_nearest(spark, d):
    o = geo.nearest_place(observations(spark, d), PLACES, legacy_stats.hour_of("ts"))
    return o.groupBy("place").agg(F.count("*").alias("n"))


# ---- deauthentication ------------------------------------------------------------------------------------------------------------------------------


def deauths(spark, d):
    return observations(spark, d).where("kind = 'error'").select("id", "ts", F.col("subject").alias("target"), (F.col("k") % 7).alias("source"), (F.col("k") % 11 + 1).alias("channel"))


_DE = "de AS (SELECT id, ts, subject AS target, k % 7 AS source, k % 11 + 1 AS channel FROM obs WHERE kind = 'error')"
_RATE = f"""{_DE}, pr AS (SELECT target, source, count(*) OVER (PARTITION BY target, source ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS c FROM de),
rates AS (SELECT target, source, count(*) AS n, CASE WHEN count(*) < 2 THEN count(*)::DOUBLE ELSE max(c) * (60.0::DOUBLE / 86400) END AS rate FROM pr GROUP BY ALL)"""


@query(f"""+ {_DE} SELECT target, source, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels
FROM de WHERE ts >= {NOW} - 30 * {DAY} GROUP BY ALL HAVING count(*) >= 3""")
def deauth_attack_groups(spark, d):
    a = radio.attacks(deauths(spark, d), NOW, 30 * DAY, 3)
    return a.withColumn("channels", F.array_join(F.transform("channels", lambda c: c.cast("string")), ","))


@query(f"+ {_RATE} SELECT target, source, n, round(rate, 9) AS rate FROM rates")
def deauth_peak_rate(spark, d):
    return radio.peak_rates(deauths(spark, d), 86400).withColumn("rate", F.round("rate", 9))


@query(f"""+ {_RATE} SELECT target, source, n, CASE WHEN rate > 0.005 OR (target < 40 AND n > 20) THEN 'CRITICAL' WHEN rate > 0.002 OR (target < 40 AND n > 10) THEN 'HIGH' WHEN rate > 0.001 OR n > 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
CASE WHEN rate > 0.001 THEN 'flood' ELSE 'targeted' END AS attack_type FROM rates""")
def deauth_severity(spark, d):
    return radio.attack_severity(radio.peak_rates(deauths(spark, d), 86400), 0.001, F.col("target") < 40).drop("rate")


@query(f"""+ {_DE}, w AS (SELECT *, max(ts) OVER (PARTITION BY target, source ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM de)
SELECT id, target, source, ts FROM w WHERE p IS NULL OR ts > p""")
def deauth_filing_novelty(spark, d):
    return windows.advancing(deauths(spark, d), ["target", "source"], "id", "ts").select("id", "target", "source", "ts")


@query(f"""+ {_DE}, r AS (SELECT *, row_number() OVER (PARTITION BY target, source, floor(ts / {DAY}) ORDER BY ts, id) AS nr FROM de) SELECT id, target, source, ts FROM r WHERE nr = 1 AND ts >= {NOW} - 15 * {DAY}""")
def dedup_keep_first(spark, d):
    e = deauths(spark, d).where(F.col("ts") >= NOW - 15 * DAY - DAY)
    return windows.keep_first(e, ["target", "source", F.floor(F.col("ts") / DAY)], ["ts", "id"]).where(F.col("ts") >= NOW - 15 * DAY).select("id", "target", "source", "ts")


@query("SELECT id, floor(value)::BIGINT AS retries, (k + 1)::BIGINT AS tx FROM obs WHERE floor(value) / (k + 1) > 0.5 AND floor(value) > 50")
def interference_filter(spark, d):
    o = observations(spark, d).select("id", F.floor("value").cast("long").alias("retries"), (F.col("k") + 1).cast("long").alias("tx"))
    return radio.interference(o)


# ---- rogue access points -----------------------------------------------------------------------------------------------------------------------------


def aps(spark, d):
    return observations(spark, d).select("id", "ts", "subject", F.concat(F.lit("net"), (F.col("k") % 20).cast("string")).alias("ssid"), (F.col("subject") % 50).alias("bssid"))


_AP = "ap AS (SELECT id, ts, subject, 'net' || (k % 20) AS ssid, subject % 50 AS bssid FROM obs)"


@query(f"""+ {_AP}, f AS (SELECT ssid, bssid, min(ts) AS first_ts FROM ap GROUP BY ALL) SELECT ssid, bssid, first_ts, row_number() OVER (PARTITION BY ssid ORDER BY first_ts, bssid) AS nth FROM f""")
def rogue_new_bssid(spark, d):
    return radio.new_radios(aps(spark, d)).withColumn("nth", F.col("nth").cast("long"))


@query(f"""+ {_AP}, t AS (SELECT *, CASE WHEN subject % 4 = 1 THEN 'OPEN' ELSE 'wpa2-psk' END AS enc, CASE WHEN bssid = 3 AND id % 2 = 0 THEN 11 ELSE 6 END AS ch FROM ap) SELECT ssid, bssid, count(*) AS n,
CASE WHEN bssid NOT IN (1, 2, 3) THEN 'CRITICAL' WHEN bool_or(enc = 'OPEN' OR ch <> 6) THEN 'MEDIUM' ELSE 'trusted' END AS verdict FROM t WHERE ssid IN ('net1', 'net2') GROUP BY ssid, bssid""")
def rogue_trusted_check(spark, d):
    """Unknown radios, and known ones with other encryption or another channel."""
    trusted = spark.createDataFrame([(f"net{i}", b, "WPA2", 6) for i in (1, 2) for b in (1, 2, 3)], "ssid string, bssid long, encryption string, channel int")
    seen = aps(spark, d).withColumns({"encryption": F.when(F.col("subject") % 4 == 1, "OPEN").otherwise("wpa2-psk"), "channel": F.when((F.col("bssid") == 3) & (F.col("id") % 2 == 0), 11).otherwise(6)})
    return radio.trusted_check(seen, trusted)


_ENC = "['OPEN', 'WEP', 'WPA-PSK', 'WPA2-PSK', 'WPA3-SAE']"
_LEVEL = "CASE WHEN {x} LIKE '%WPA3%' THEN 4 WHEN {x} LIKE '%WPA2%' THEN 3 WHEN {x} LIKE '%WPA%' THEN 2 WHEN {x} LIKE '%WEP%' THEN 1 ELSE 0 END"


@query(f"""+ e AS (SELECT {_ENC}[subject % 5 + 1] AS expected, {_ENC}[k % 5 + 1] AS actual FROM obs)
SELECT expected, actual, ({_LEVEL.format(x='actual')}) < ({_LEVEL.format(x='expected')}) AS downgrade, expected = actual AS matches, count(*) AS n FROM e GROUP BY ALL""")
def encryption_downgrade(spark, d):
    names = F.array(*(F.lit(x) for x in ("OPEN", "WEP", "WPA-PSK", "WPA2-PSK", "WPA3-SAE")))
    e = observations(spark, d).select(F.get(names, (F.col("subject") % 5).cast("int")).alias("expected"), F.get(names, F.col("k") % 5).alias("actual"))
    return e.groupBy("expected", "actual", C.is_downgrade("expected", "actual").alias("downgrade"), C.encryption_matches("expected", "actual").alias("matches")).agg(F.count("*").alias("n"))


@query("""SELECT f AS khz, CASE WHEN f <= 2472000 THEN (f - 2412000) // 5000 + 1 ELSE (f - 5000000) // 5000 END AS channel, count(*) AS n
FROM (SELECT CASE WHEN k < 50 THEN 2412000 + (k % 13) * 5000 ELSE 5180000 + (k % 8) * 20000 END AS f FROM obs) GROUP BY ALL""")
def frequency_channel(spark, d):
    f = F.when(F.col("k") < 50, 2412000 + (F.col("k") % 13) * 5000).otherwise(5180000 + (F.col("k") % 8) * 20000)
    return observations(spark, d).select(f.alias("khz")).groupBy("khz", C.channel_of("khz").alias("channel")).agg(F.count("*").alias("n"))


@query("""+ b AS (SELECT id, CASE WHEN k % 4 = 0 THEN 'AirTag' WHEN k % 4 = 1 THEN 'my Tile' WHEN k % 4 = 2 THEN 'phone' ELSE '' END AS name, CASE WHEN k % 5 = 0 THEN 'Find My continuity' WHEN k % 5 = 1 THEN 'airtag' ELSE '' END AS blob, kind IN ('view', 'click') AS ble FROM obs),
s AS (SELECT CASE WHEN NOT ble THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.25::DOUBLE + CASE WHEN name IN ('AirTag', 'my Tile') THEN 0.55::DOUBLE ELSE 0 END + CASE WHEN blob LIKE 'Find%' THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN blob = 'airtag' THEN 0.4::DOUBLE ELSE 0 END) END AS score FROM b)
SELECT round(score, 6) AS score, count(*) AS n, CASE WHEN score >= 0.8 THEN 'alert' WHEN score >= 0.5 THEN 'watch' ELSE 'entity' END AS filed FROM s GROUP BY ALL""")
def ble_tracker_score(spark, d):
    k = F.col("k")
    name = F.when(k % 4 == 0, "AirTag").when(k % 4 == 1, "my Tile").when(k % 4 == 2, "phone").otherwise("")
    blob = F.when(k % 5 == 0, "Find My continuity").when(k % 5 == 1, "airtag").otherwise("")
    s = observations(spark, d).select(C.tracker_score(name, blob, F.col("kind").isin("view", "click")).alias("s"))
    return s.groupBy(F.round("s", 6).alias("score"), F.when(F.col("s") >= 0.8, "alert").when(F.col("s") >= 0.5, "watch").otherwise("entity").alias("filed")).agg(F.count("*").alias("n"))


# ---- places and paths ----------------------------------------------------------------------------------------------------------------------------------


@query(f"""+ p AS (SELECT DISTINCT k, lat, lon FROM obs) SELECT a.k AS k_a, b.k AS k_b, round({_DIST.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')}, 3) AS metres FROM p a JOIN p b ON a.k + 1 = b.k""")
def haversine_pairs(spark, d):
    return _neighbours(observations(spark, d))


def _neighbours(o):
    p = o.select("k", "lat", "lon").distinct()
    q = p.select(F.col("k").alias("k_b"), (F.col("k") - 1).alias("k_a"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    return p.withColumnRenamed("k", "k_a").join(q, "k_a").select("k_a", "k_b", F.round(C.haversine("lat", "lon", "lat_b", "lon_b"), 3).alias("metres"))


@query("SELECT DISTINCT k, 'loc_' || substr(sha1(printf('%.6f', lat) || ',' || printf('%.6f', lon)), 1, 12) AS place_id FROM obs")
def stable_place_id(spark, d):
    return observations(spark, d).select("k", C.place_id("lat", "lon").alias("place_id")).distinct()


def _clustered(spark, d):
    o = observations(spark, d)
    return geo.assign_clusters(o.select("subject", "ts", "lat", "lon", "id", "k"))


_CL = "cl AS (SELECT *, dense_rank() OVER (PARTITION BY subject ORDER BY f) - 1 AS cluster FROM (SELECT *, min(ts) OVER (PARTITION BY subject, k) AS f FROM obs))"
_VI = f"""{_CL}, g AS (SELECT *, CASE WHEN lag(k) OVER w IS DISTINCT FROM k OR ts - lag(ts) OVER w > 604800 THEN 1 ELSE 0 END AS nw FROM cl WINDOW w AS (PARTITION BY subject ORDER BY ts, lat, lon)),
v0 AS (SELECT *, sum(nw) OVER (PARTITION BY subject ORDER BY ts, lat, lon ROWS UNBOUNDED PRECEDING) AS visit FROM g),
v1 AS (SELECT subject, visit::BIGINT AS visit, min(cluster) AS cluster, min(k) AS k, min(ts) AS enter_ts, max(ts) AS end_ts, count(*) AS n FROM v0 GROUP BY subject, visit),
fl AS (SELECT subject, k, arg_min(lat, (ts, lat, lon)) AS lat, arg_min(lon, (ts, lat, lon)) AS lon FROM obs GROUP BY subject, k),
v AS (SELECT v1.subject, visit, cluster, enter_ts, CASE WHEN visit < max(visit) OVER (PARTITION BY v1.subject) THEN end_ts END AS exit_ts, n, lat, lon FROM v1 JOIN fl ON v1.subject = fl.subject AND v1.k = fl.k)"""


@query(f"+ {_CL} SELECT subject, cluster::INTEGER AS cluster, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM cl GROUP BY ALL")
def leader_clusters(spark, d):
    return geo.cluster_summary(_clustered(spark, d)).drop("lat", "lon")


def _visits(spark, d):
    return geo.visits(_clustered(spark, d), 7 * DAY)


@query(f"+ {_VI} SELECT subject, visit, cluster::INTEGER AS cluster, enter_ts, exit_ts, n FROM v")
def visit_sessions(spark, d):
    return _visits(spark, d).drop("lat", "lon")


_DIST_R = _DIST.format(a="r.lat", b="n.lat", c="r.lon", d="n.lon")


@query(f"""WITH RECURSIVE {OBS}, {_VI}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY enter_ts, visit) AS nr FROM v),
r AS (SELECT subject, nr, visit, cluster, enter_ts, exit_ts, n, lat, lon, coalesce(exit_ts, enter_ts) AS left_ts, true AS keep FROM n WHERE nr = 1 UNION ALL
 SELECT subject, nr, visit, cluster, enter_ts, exit_ts, n, CASE WHEN ok THEN lat ELSE plat END, CASE WHEN ok THEN lon ELSE plon END, CASE WHEN ok THEN coalesce(exit_ts, enter_ts) ELSE pleft END, ok
 FROM (SELECT n.*, r.lat AS plat, r.lon AS plon, r.left_ts AS pleft, {_DIST_R} <= 0.05::DOUBLE * greatest(n.enter_ts - r.left_ts, 0) + 60 AS ok FROM r JOIN n ON n.subject = r.subject AND n.nr = r.nr + 1))
SELECT subject, visit, cluster::INTEGER AS cluster, enter_ts, exit_ts, n FROM r WHERE keep""", obs=False)
def feasible_visits(spark, d):
    """Visits that can be reached from the last one kept."""
    return geo.feasible_visits(_visits(spark, d), 0.05, 30.0).drop("lat", "lon")


_DIST_V = _DIST.format(a="e.lat", b="o.lat", c="e.lon", d="o.lon")
_CO = f"""{_VI}, co AS (SELECT e.subject, e.visit, e.enter_ts, e.exit_ts, o.visit AS op_visit, o.enter_ts AS op_enter, o.cluster AS op_cluster FROM v e JOIN v o ON o.subject = 0 AND e.subject <> 0
 AND e.enter_ts <= coalesce(o.exit_ts, o.enter_ts + 432000) AND o.enter_ts <= coalesce(e.exit_ts, e.enter_ts + 432000) AND {_DIST_V} <= 60)"""


def _met(spark, d):
    v = _visits(spark, d)
    return geo.cotravel(v.where(F.col("subject") != OPERATOR), v.where(F.col("subject") == OPERATOR), gap=5 * DAY)


@query(f"+ {_CO} SELECT subject, visit, op_visit, enter_ts, op_enter FROM co")
def cotravel_matches(spark, d):
    return _met(spark, d).select("subject", "visit", "op_visit", "enter_ts", "op_enter")


@query(f"""+ {_CO}, a AS (SELECT subject, count(DISTINCT (op_enter, op_cluster)) AS places, max(coalesce(exit_ts, enter_ts)) - min(enter_ts) AS span FROM co GROUP BY subject), s AS (SELECT subject, count(*) AS sees FROM obs GROUP BY subject)
SELECT subject, places, span, sees, round(least(1.0::DOUBLE, places / 5 * 0.5::DOUBLE + least(span / 3600, 6.0::DOUBLE) / 12 + least(sees, 20) / 40), 6) AS score FROM a JOIN s USING (subject) WHERE places >= 1 AND span >= 0""")
def cotravel_score(spark, d):
    sees = observations(spark, d).groupBy("subject").agg(F.count("*").alias("sees"))
    return geo.cotravel_scores(_met(spark, d), sees, 1, 0.0)


@query(f"""+ {_VI}, m AS (SELECT v.subject, v.visit, count(DISTINCT s.subject) AS others FROM v JOIN obs s ON s.subject <> v.subject AND s.subject <> 0 AND s.ts BETWEEN v.enter_ts - 3600 AND coalesce(v.exit_ts, v.enter_ts) + 3600
AND s.lat BETWEEN v.lat - 0.01 AND v.lat + 0.01 AND s.lon BETWEEN v.lon - 0.01 AND v.lon + 0.01 AND {_DIST.format(a='v.lat', b='s.lat', c='v.lon', d='s.lon')} <= 30 GROUP BY ALL)
SELECT v.subject, v.visit, coalesce(others, 0) AS others FROM v LEFT JOIN m ON v.subject = m.subject AND v.visit = m.visit""")
def attendance_density(spark, d):
    return geo.density(_visits(spark, d), observations(spark, d), OPERATOR, around=3600.0, slot=7200.0)


@query("SELECT subject, k AS location, min(ts) AS first_seen, arg_max(ts, id) AS last_seen, arg_max(lat, id) AS lat, arg_max(lon, id) AS lon, count(*) AS see_count FROM obs GROUP BY subject, k")
def location_sightings_upsert(spark, d):
    return upserts.location_sightings(observations(spark, d).withColumnRenamed("k", "location"), ["subject", "location"])


@query("""+ s AS (SELECT subject, k, count(*) AS c FROM obs GROUP BY ALL) SELECT subject, count(DISTINCT k) AS locations, sum(c)::BIGINT AS sees FROM s GROUP BY subject HAVING count(DISTINCT k) >= 2 ORDER BY locations DESC, sees DESC, subject LIMIT 15""")
def multi_location_entities(spark, d):
    return upserts.multi_location(upserts.location_sightings(observations(spark, d).withColumnRenamed("k", "location"), ["subject", "location"]))


@query("""WITH RECURSIVE obs AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS ts, user_id AS subject, 33.4::DOUBLE + 0.01::DOUBLE * (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) + 0.00005::DOUBLE * (event_id % 5) AS lat,
  -112.0::DOUBLE - 0.01::DOUBLE * floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 10) AS lon FROM events), n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts, id) AS nr FROM obs),
r AS (SELECT subject, nr, id, lat, lon, true AS keep FROM n WHERE nr = 1 UNION ALL SELECT n.subject, n.nr, n.id, CASE WHEN far THEN n.lat ELSE n.plat END, CASE WHEN far THEN n.lon ELSE n.plon END, far
  FROM (SELECT n.*, r.lat AS plat, r.lon AS plon, sqrt((n.lat - r.lat) * (n.lat - r.lat) + (n.lon - r.lon) * (n.lon - r.lon)) * 111000 >= 5000 AS far FROM r JOIN n ON n.subject = r.subject AND n.nr = r.nr + 1) n)
SELECT id, subject FROM r WHERE keep""", obs=False)
def gps_thin(spark, d):
    """Points 5 km from the last one kept."""
    return geo.thin(observations(spark, d).select("id", "ts", "subject", "lat", "lon"), 5000.0).select("id", "subject")


# ---- upserts -----------------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT kind, subject, min(ts) AS first_seen, arg_max(ts, id) AS last_seen, count(*) AS see_count, arg_max(k, id) FILTER (k % 3 = 0) AS meta FROM obs GROUP BY kind, subject")
def entity_upsert(spark, d):
    return upserts.entities(observations(spark, d).withColumn("meta", F.when(F.col("k") % 3 == 0, F.col("k"))), ["kind", "subject"])


@query("SELECT subject, kind AS detector, count(*) AS hits, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(k, id) AS detail FROM obs GROUP BY subject, kind")
def contribution_upsert(spark, d):
    return upserts.contributions(observations(spark, d).select("subject", F.col("kind").alias("detector"), "ts", "id", F.col("k").alias("detail")), ["subject", "detector"])


@query("SELECT subject AS entity, k % 8 AS fingerprint, max(value) AS confidence, min(ts) AS linked_ts FROM obs GROUP BY ALL")
def fingerprint_links(spark, d):
    return upserts.links(observations(spark, d).select(F.col("subject").alias("entity"), (F.col("k") % 8).alias("fingerprint"), F.col("value").alias("confidence"), "ts"))


@query(f"SELECT kind, count(*) AS kept FROM obs WHERE ts >= {NOW} - 7 * 86400 GROUP BY kind")
def retention_purge(spark, d):
    return upserts.purge(observations(spark, d), NOW, 7).groupBy("kind").agg(F.count("*").alias("kept"))


@query(f"""+ e AS (SELECT subject, arg_max(ts, id) AS last_seen FROM obs GROUP BY subject) SELECT subject, last_seen FROM e WHERE last_seen < {NOW} + 64800 AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.subject = e.subject AND o.kind = 'error' AND o.ts >= {NOW} - 86400)
AND NOT EXISTS (SELECT 1 FROM obs o WHERE o.subject = e.subject AND o.kind = 'signup' AND o.k = 1)""")
def retention_entity_pin(spark, d):
    """Entities out of sight for six hours of a clock a day on, not held by an incident of two days nor by a fingerprint."""
    o = observations(spark, d)
    e = upserts.entities(o, ["subject"]).select("subject", "last_seen")
    return upserts.pinned(e, NOW + DAY, 0.25, o.where((F.col("kind") == "error") & (F.col("ts") >= NOW - DAY)).select("subject"), o.where((F.col("kind") == "signup") & (F.col("k") == 1)).select("subject"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority LIKE '1%') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", obs=False)
def semi_anti_purge(spark, d):
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    o = o.where("o_orderstatus = 'P' AND o_orderpriority LIKE '1%'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").join(n.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_mktsegment")


# ---- identity ------------------------------------------------------------------------------------------------------------------------------------------------

_VIEWS = """vw AS (SELECT subject AS key, list_sort(list(DISTINCT k)) AS ssids, list_sort(list(DISTINCT k % 8)) AS tags, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM obs GROUP BY subject),
ex AS (SELECT key, unnest(ssids) AS f FROM vw), pr AS (SELECT a.key AS key_a, b.key AS key_b, count(*) AS shared FROM ex a JOIN ex b ON a.f = b.f AND a.key < b.key GROUP BY ALL)"""


def _views(spark, d, located=False):
    return identity.views(observations(spark, d).withColumn("tag", F.col("k") % 8), "subject", "k", "tag", located)


@query(f"+ {_VIEWS} SELECT * FROM pr WHERE shared >= 5")
def fingerprint_pairs(spark, d):
    return identity.candidate_pairs(_views(spark, d)).where("shared >= 5")


_LINK = f"""{_VIEWS}, pl AS (SELECT DISTINCT subject AS key, round(lat, 6) AS la, round(lon, 6) AS lo FROM obs), pt AS (SELECT DISTINCT la, lo, la || ',' || lo AS p FROM pl),
nb AS (SELECT a.p, b.p AS q FROM pt a JOIN pt b ON b.la BETWEEN a.la - 0.001 AND a.la + 0.001 AND b.lo BETWEEN a.lo - 0.001 AND a.lo + 0.001 AND {_DIST.format(a='a.la', b='b.la', c='a.lo', d='b.lo')} <= 50),
ow AS (SELECT key, list(la || ',' || lo) AS places FROM pl GROUP BY key), rc AS (SELECT key, list(DISTINCT q) AS reached FROM pl JOIN nb ON nb.p = la || ',' || lo GROUP BY key),
j AS (SELECT pr.*, len(list_intersect(oa.places, rb.reached)) / len(oa.places) AS ab, len(list_intersect(ob.places, ra.reached)) / len(ob.places) AS ba, a.ssids AS sa, b.ssids AS sb, a.tags AS ta, b.tags AS tb, a.first_ts AS fa, b.first_ts AS fb, a.last_ts AS la, b.last_ts AS lb, a.n AS na, b.n AS nb FROM pr JOIN vw a ON a.key = key_a JOIN vw b ON b.key = key_b JOIN ow oa ON oa.key = key_a JOIN ow ob ON ob.key = key_b JOIN rc ra ON ra.key = key_a JOIN rc rb ON rb.key = key_b),
sc AS (SELECT *, greatest(fa, fb) - least(la, lb) <= 30 AS together,
 0.1::DOUBLE * (ab + ba) / 2 + 0.45::DOUBLE * (len(list_intersect(sa, sb)) / len(list_distinct(sa || sb))) + CASE WHEN shared >= 2 THEN 0.06::DOUBLE * least(shared - 1, 5) ELSE 0 END + 0.25::DOUBLE * (len(list_intersect(ta, tb)) / len(list_distinct(ta || tb)))
 + 0.15::DOUBLE * least(1.0::DOUBLE, ((CASE WHEN fb - la > 30 AND fb - la <= 300 THEN 1 ELSE 0 END) + (CASE WHEN fa - lb > 30 AND fa - lb <= 300 THEN 1 ELSE 0 END)) / 2)
 + 0.05::DOUBLE * (CASE WHEN na >= 3 AND nb >= 3 AND la > fa AND lb > fb THEN least((la - fa) / (na - 1), (lb - fb) / (nb - 1)) / greatest((la - fa) / (na - 1), (lb - fb) / (nb - 1)) ELSE 0 END) AS total FROM j),
ls AS (SELECT *, CASE WHEN together THEN 0.0::DOUBLE ELSE round(greatest(0, least(1.0::DOUBLE, total)), 6) END AS confidence FROM sc)"""


@query(f"""+ {_LINK} SELECT key_a, key_b, substr(sha256(least(key_a::VARCHAR, key_b::VARCHAR) || '|' || greatest(key_a::VARCHAR, key_b::VARCHAR)), 1, 16) AS hypothesis_id, shared, confidence,
CASE WHEN together THEN 'rejected' WHEN confidence >= 0.7 AND shared >= 2 THEN 'linked' ELSE 'candidate' END AS status FROM ls WHERE together OR confidence >= 0.3""")
def link_score(spark, d):
    return identity.links(_views(spark, d, True))


@query("""+ f AS (SELECT subject AS key_a, k AS key_b, id AS seq, value AS confidence, CASE WHEN kind = 'signup' AND id % 10 = 0 THEN 'rejected' WHEN value > 60 THEN 'linked' ELSE 'candidate' END AS status FROM obs)
SELECT key_a, key_b, count(*) AS n, min(seq) AS created_seq, CASE WHEN bool_or(status = 'rejected') THEN 0.0::DOUBLE ELSE max(confidence) END AS confidence, CASE WHEN bool_or(status = 'rejected') THEN 'rejected' ELSE arg_max(status, (confidence, seq)) END AS status FROM f GROUP BY ALL""")
def hypothesis_merge(spark, d):
    o = observations(spark, d)
    status = F.when((F.col("kind") == "signup") & (F.col("id") % 10 == 0), "rejected").when(F.col("value") > 60, "linked").otherwise("candidate")
    return identity.merge_hypotheses(o.select(F.col("subject").alias("key_a"), F.col("k").alias("key_b"), F.col("id").alias("seq"), F.col("value").alias("confidence"), status.alias("status")))


@query("""+ h AS (SELECT subject AS entity, k AS fingerprint, value / 600 AS confidence, id FROM obs WHERE value / 600 >= 0.1), b AS (SELECT fingerprint, arg_max(entity, (confidence, -id)) AS entity, max(confidence) AS confidence FROM h GROUP BY fingerprint)
SELECT fingerprint, entity, confidence, CASE WHEN confidence >= 0.95 THEN 'alert' ELSE 'watch' END AS severity FROM b""")
def relink_incidents(spark, d):
    h = observations(spark, d).select(F.col("subject").alias("entity"), F.col("k").alias("fingerprint"), (F.col("value") / 600).alias("confidence"), "id").where("confidence >= 0.1")
    b = h.groupBy("fingerprint").agg(F.max(F.struct("confidence", (-F.col("id")).alias("o"), "entity")).alias("b"))
    return b.select("fingerprint", "b.entity", "b.confidence", F.when(F.col("b.confidence") >= 0.95, "alert").otherwise("watch").alias("severity"))


# ---- fusion and incidents ---------------------------------------------------------------------------------------------------------------------------------------


def _evidence(spark, d, detector=False):
    kinds = F.array(*(F.lit(k) for k in list(incidents.WEIGHTS)[:8]))
    o = observations(spark, d).select("subject", F.get(kinds, F.col("k") % 8).alias("kind"), F.lpad(F.col("id").cast("string"), 12, "0").alias("detail"), (F.col("k") % 10 == 9).alias("contra"), *([F.col("kind").alias("detector")] if detector else []))
    return incidents.weigh(o.withColumn("kind", F.when(F.col("contra"), "density").otherwise(F.col("kind"))))


_W = "CASE kind WHEN 'deauth_pattern' THEN 0.35 WHEN 'attack_signature' THEN 0.2 WHEN 'source_severity' THEN 0.15 WHEN 'rogue_reason' THEN 0.25 WHEN 'ble_signal' THEN 0.25 WHEN 'copresence' THEN 0.3 WHEN 'travel_span' THEN 0.25 WHEN 'score' THEN 0.1 WHEN 'density' THEN 0.06 ELSE 0.1 END::DOUBLE"
_EV = f"""ev0 AS (SELECT subject, CASE WHEN k % 10 = 9 THEN 'density' ELSE ['deauth_pattern', 'attack_signature', 'source_severity', 'rogue_reason', 'ble_signal', 'copresence', 'travel_span', 'score'][k % 8 + 1] END AS kind, lpad(id::VARCHAR, 12, '0') AS detail, k % 10 = 9 AS contra FROM obs),
ev AS (SELECT *, {_W} AS w FROM ev0),
fu AS (SELECT subject, coalesce(list_reduce(list(1 - w ORDER BY kind, detail) FILTER (NOT contra), lambda a, b: a * b), 1) AS s, coalesce(list_reduce(list(1 - w ORDER BY kind, detail) FILTER (contra), lambda a, b: a * b), 1) AS c,
 count(DISTINCT kind) FILTER (NOT contra AND kind NOT IN ('attack_signature', 'score', 'source_severity')) AS kinds FROM ev GROUP BY subject),
fz AS (SELECT subject, round(greatest(0, least((1 - s) * c, 0.99::DOUBLE)), 6) AS confidence, kinds, kinds >= 2 AS may_alert FROM fu)"""


@query(f"+ {_EV} SELECT * FROM fz")
def fuse_by_subject(spark, d):
    return incidents.fuse_by(_evidence(spark, d), ["subject"])


@query(f"+ {_EV} SELECT CASE WHEN confidence >= 0.6 AND may_alert THEN 'alert' WHEN confidence >= 0.3 THEN 'watch' ELSE 'info' END AS level, count(*) AS n FROM fz GROUP BY 1")
def alert_gate(spark, d):
    return _gated(_evidence(spark, d))


def _gated(evidence):
    f = incidents.fuse_by(evidence, ["subject"])
    return f.groupBy(incidents.gated("confidence", "may_alert").alias("level")).agg(F.count("*").alias("n"))


@query(f"+ {_EV} SELECT kind, count(*) AS n, round(sum(w), 6) AS weight FROM ev GROUP BY kind")
def weight_assignment(spark, d):
    return _evidence(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("weight"))


_LIST = "list(1 - w ORDER BY kind, detail, w)"


@query(f"""WITH e AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'copresence' WHEN 1 THEN 'deauth_pattern' ELSE 'score' END AS kind, l_linenumber AS detail, l_discount::DOUBLE AS w, l_returnflag = 'R' AS contra FROM lineitem)
SELECT l_orderkey, floor(greatest(0, least((1 - coalesce(list_reduce({_LIST} FILTER (NOT contra), lambda a, b: a * b), 1)) * coalesce(list_reduce({_LIST} FILTER (contra), lambda a, b: a * b), 1), 0.99::DOUBLE)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS confidence,
count(DISTINCT kind) FILTER (NOT contra AND kind <> 'score') AS kinds FROM e GROUP BY l_orderkey""", obs=False)
def fuse_evidence(spark, d):
    """Orders as cases, their lines as evidence for or, if returned, against; discounts weigh."""
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "copresence").when(n % 3 == 1, "deauth_pattern").otherwise("score")
    l = table(spark, d, "lineitem").select("l_orderkey", kind.alias("kind"), n.alias("detail"), F.col("l_discount").cast("double").alias("w"), (F.col("l_returnflag") == "R").alias("contra"))
    return incidents.fuse_by(l, ["l_orderkey"]).drop("may_alert")


@query(f"""+ w AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY kind, subject ORDER BY ts, id) <= 2 * {DAY} THEN 0 ELSE 1 END AS nw FROM obs), e AS (SELECT *, sum(nw) OVER (PARTITION BY kind, subject ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS episode FROM w)
SELECT kind, subject, episode::BIGINT AS episode, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY ALL""")
def incident_dedup_reopen(spark, d):
    return incidents.episodes(observations(spark, d), ["kind", "subject"], 2 * DAY)


_WANT = """CASE WHEN confidence >= 0.6 AND kinds >= 2 AND len({d}) >= 2 THEN 3 WHEN confidence >= 0.3 THEN 2 WHEN nd >= 2 OR len({c}) >= 2 THEN 1 ELSE 0 END"""
_NEXT = "CASE WHEN want > st THEN want WHEN want < st THEN greatest(want, 1) ELSE st END"


@query(f"""WITH RECURSIVE {OBS}, l0 AS (SELECT 'ph:dev:' || subject AS phenomenon, floor(ts / {DAY})::BIGINT AS cycle, kind AS detector, {list(incidents.WEIGHTS)}[k % 9 + 1] AS kind, id::VARCHAR AS detail FROM obs),
l AS (SELECT *, {_W} AS w, kind = 'density' AS contra FROM l0),
g AS (SELECT phenomenon, cycle, coalesce(list_reduce({_LIST} FILTER (NOT contra), lambda a, b: a * b), 1) AS s, coalesce(list_reduce({_LIST} FILTER (contra), lambda a, b: a * b), 1) AS x,
 count(DISTINCT kind) FILTER (NOT contra AND kind NOT IN ('attack_signature', 'score', 'source_severity')) AS kinds, count(DISTINCT detector) AS nd, list(DISTINCT detector) AS dets, list(DISTINCT detector || '/' || kind) AS cons FROM l GROUP BY ALL),
c AS MATERIALIZED (SELECT *, floor(greatest(0, least((1 - s) * x, 0.99::DOUBLE)) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS confidence, row_number() OVER (PARTITION BY phenomenon ORDER BY cycle) AS nr FROM g),
r AS (SELECT phenomenon, cycle, nr, confidence, want AS state, dets, cons FROM (SELECT *, {_WANT.format(d='dets', c='cons')} AS want FROM c WHERE nr = 1) UNION ALL
 SELECT phenomenon, cycle, nr, confidence, {_NEXT}, all_d, all_c FROM (SELECT *, {_WANT.format(d='all_d', c='all_c')} AS want FROM (
  SELECT c.phenomenon, c.cycle, c.nr, c.confidence, c.kinds, c.nd, CASE WHEN gone THEN c.dets ELSE list_distinct(c.dets || pd) END AS all_d, CASE WHEN gone THEN c.cons ELSE list_distinct(c.cons || pc) END AS all_c,
   CASE WHEN ps = 0 OR gone THEN 0 WHEN ps = 1 THEN 1 ELSE greatest(1, ps - greatest(0, c.cycle - pcycle - 2)) END AS st
  FROM (SELECT r.phenomenon AS ph, r.nr AS pnr, r.cycle AS pcycle, r.state AS ps, r.dets AS pd, r.cons AS pc FROM r) p JOIN (SELECT *, false AS f FROM c) c ON c.phenomenon = ph AND c.nr = pnr + 1, LATERAL (SELECT ps > 0 AND c.cycle - pcycle > 5 AS gone) z)))
SELECT phenomenon, cycle, ['NEW', 'OBSERVING', 'WATCH', 'ALERT'][state + 1] AS state, confidence, len(dets)::INTEGER AS detectors FROM r""", obs=False)
def incident_lifecycle(spark, d):
    """States of all phenomena after each cycle with evidence (I4-I7). A cycle is a day; decay after two, close after five."""
    kinds = F.array(*(F.lit(k) for k in list(incidents.WEIGHTS)))
    o = observations(spark, d).select(
        F.concat(F.lit("ph:dev:"), F.col("subject").cast("string")).alias("phenomenon"), F.floor(F.col("ts") / DAY).cast("long").alias("cycle"), F.col("kind").alias("detector"),
        F.get(kinds, F.col("k") % 9).alias("kind"), F.col("id").cast("string").alias("detail"),
    )
    return incidents.lifecycle(incidents.weigh(o).withColumn("contra", F.col("kind") == "density"), DAY, 2 * DAY, 5 * DAY)


def _incidents(spark, d):
    o = observations(spark, d)
    key = F.concat_ws("|", "kind", F.col("subject").cast("string"))
    return o.groupBy(key.alias("incident_key")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.when(F.max("value") > 60, "alert").otherwise("watch").alias("severity"))


_INC = "inc AS (SELECT kind || '|' || subject AS incident_key, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, CASE WHEN max(value) > 60 THEN 'alert' ELSE 'watch' END AS severity FROM obs GROUP BY 1)"


@query(f"""+ {_INC}, a AS (SELECT count(*) FILTER (last_ts >= {NOW} - {DAY} AND severity = 'alert') AS alerts, count(*) FILTER (last_ts >= {NOW} - {DAY} AND severity = 'watch') AS watches, count(*) AS incidents, max(last_ts) AS last_ts FROM inc)
SELECT *, CASE WHEN alerts > 0 THEN 'alert' WHEN watches > 0 THEN 'watch' ELSE 'clear' END AS state FROM a""")
def status_rollup(spark, d):
    return incidents.status_rollup(_incidents(spark, d), NOW, DAY)


@query(f"+ {_INC} SELECT incident_key, severity, last_ts, n FROM inc ORDER BY CASE severity WHEN 'alert' THEN 0 ELSE 1 END, last_ts DESC, incident_key LIMIT 5")
def open_incident_topk(spark, d):
    return incidents.top_open(_incidents(spark, d), 5).select("incident_key", "severity", "last_ts", "n")


@query(f"""+ {_INC}, day AS (SELECT unnest(range(0, 30)) AS dd) SELECT dd::INTEGER AS day, count(*) FILTER (first_ts >= lo AND first_ts < hi) AS opened, count(*) FILTER (last_ts >= lo AND last_ts < hi) AS closed, count(*) FILTER (first_ts < hi AND last_ts >= lo) AS overlapping
FROM inc, (SELECT dd, {NOW} - (dd + 1) * {DAY} AS lo, {NOW} - dd * {DAY} AS hi FROM day) GROUP BY dd""")
def debrief_transitions(spark, d):
    return _transitions(spark, _incidents(spark, d))


def _transitions(spark, i):
    day = lambda c: F.floor((NOW - F.col(c)) / DAY)
    back = lambda c: F.when((NOW - F.col(c)) % DAY == 0, day(c) - 1).otherwise(day(c)).cast("int")
    i = i.withColumns({"o": back("first_ts"), "c": back("last_ts")})
    days = spark.range(30).select(F.col("id").cast("int").alias("day"))
    opened = i.groupBy(F.col("o").alias("day")).agg(F.count("*").alias("opened"))
    closed = i.groupBy(F.col("c").alias("day")).agg(F.count("*").alias("closed"))
    # a sequence runs backwards where its end is before its beginning: incidents outside the thirty days have none
    over = i.where("o >= 0 and c <= 29").select(F.explode(F.sequence(F.greatest("c", F.lit(0)), F.least("o", F.lit(29)))).alias("day")).groupBy("day").agg(F.count("*").alias("overlapping"))
    out = days.join(opened, "day", "left").join(closed, "day", "left").join(over, "day", "left")
    return out.na.fill(0, ["opened", "closed", "overlapping"])


@query("""SELECT o_orderkey, o_orderpriority, n, first_ship FROM (SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) l JOIN orders ON o_orderkey = l_orderkey
WHERE first_ship < TIMESTAMP '1996-01-01' AND last_ship >= TIMESTAMP '1995-12-01' ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, n DESC, o_orderkey LIMIT 20""", obs=False)
def debrief_overlap_topk(spark, d):
    """Spans that overlap a month, the twenty first by severity and count (R4), on orders and their shipments."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    l = l.where((F.col("first_ship") < F.expr("TIMESTAMP_NTZ'1996-01-01 00:00:00'")) & (F.col("last_ship") >= F.expr("TIMESTAMP_NTZ'1995-12-01 00:00:00'")))
    j = l.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.orderBy(F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1), F.desc("n"), "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority", "n", "first_ship")


# ---- slots, clocks, queues -----------------------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT subject, (k % 4 + floor(({NOW} - ({NOW} - (id % 5) * 300)) / 300))::BIGINT AS slot FROM obs WHERE (k % 4 + floor(({NOW} - ({NOW} - (id % 5) * 300)) / 300)) < 4")
def slot_ageing(spark, d):
    s = observations(spark, d).select("subject", (F.col("k") % 4).alias("slot"), (NOW - (F.col("id") % 5) * 300).alias("saved_ts"))
    return windows.aged_slots(s, NOW)


@query("""+ a AS (SELECT DISTINCT subject, k % 4 AS slot FROM obs WHERE kind = 'view'), b AS (SELECT DISTINCT subject, k % 4 AS slot FROM obs WHERE kind = 'click') SELECT slot, count(*) AS n, count(*) FILTER (added) AS added FROM
(SELECT subject, slot, false AS added FROM a UNION ALL SELECT subject, slot, true FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.subject = b.subject AND a.slot = b.slot)) GROUP BY slot""")
def slot_union(spark, d):
    o = observations(spark, d)
    a, b = (o.where(F.col("kind") == k).select("subject", (F.col("k") % 4).alias("slot")).distinct() for k in ("view", "click"))
    u = a.withColumn("added", F.lit(False)).unionByName(b.join(a, ["subject", "slot"], "left_anti").withColumn("added", F.lit(True)))
    return u.groupBy("slot").agg(F.count("*").alias("n"), F.count_if("added").alias("added"))


@query(f"SELECT subject, slot, count(*) AS n FROM obs JOIN (SELECT unnest([0, 1, 2, 3]) AS slot) s ON ts BETWEEN {NOW} - (slot + 1) * 172800 AND {NOW} - slot * 172800 GROUP BY ALL")
def slot_init_labels(spark, d):
    return windows.slot_labels(observations(spark, d), NOW, 172800 / 5).groupBy("subject", "slot").agg(F.count("*").alias("n"))


@query(f"+ m AS (SELECT subject, max(ts) + 1 AS wm FROM obs GROUP BY subject) SELECT subject, greatest(CASE WHEN wm > {NOW} - 86400 + 300 THEN 0 ELSE wm END, greatest(0, {NOW} - 86400 - 1800)) AS start_ts FROM m")
def watermark_scan_start(spark, d):
    m = observations(spark, d).groupBy("subject").agg((F.max("ts") + 1).alias("wm"))
    return m.select("subject", C.scan_start("wm", F.lit(NOW - DAY)).alias("start_ts"))


@query(f"""+ m AS (SELECT subject, max(ts) AS t FROM obs GROUP BY subject) SELECT subject, CASE WHEN t > {NOW} - 43200 + 300 THEN 'ahead' WHEN {NOW} - 43200 - t > 900 THEN 'dropout' ELSE 'ok' END AS clock, CASE WHEN {NOW} - t > 150000 THEN 'fail' ELSE 'clear' END AS effective FROM m""")
def clock_skew(spark, d):
    m = observations(spark, d).groupBy("subject").agg(F.max("ts").alias("t"))
    clock = F.when(F.col("t") > NOW - 43200 + 300, "ahead").when(NOW - 43200 - F.col("t") > 900, "dropout").otherwise("ok")
    stale = NOW - F.col("t") > 150000
    return m.select("subject", clock.alias("clock"), C.state_of(stale, F.lit(False), F.lit(False), F.lit(False)).alias("effective"))


@query(f"""WITH RECURSIVE {OBS}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY kind, subject ORDER BY ts, id) AS nr FROM obs),
r AS (SELECT id, kind, subject, ts, nr, ts AS sent, true AS keep FROM n WHERE nr = 1 UNION ALL
 SELECT n.id, n.kind, n.subject, n.ts, n.nr, CASE WHEN n.ts - r.sent >= 3 * {DAY} THEN n.ts ELSE r.sent END, n.ts - r.sent >= 3 * {DAY} FROM r JOIN n ON n.kind = r.kind AND n.subject = r.subject AND n.nr = r.nr + 1)
SELECT id, kind, subject, ts FROM r WHERE keep""", obs=False)
def push_cooldown(spark, d):
    """A message goes out if its last one that did is three days old: the one before need not have gone out (K7)."""
    return windows.cooled(observations(spark, d), ["kind", "subject"], "ts", 3 * DAY, ["ts", "id"]).select("id", "kind", "subject", "ts")


@query("""+ s AS (SELECT id, subject, ts, CASE kind WHEN 'error' THEN 'alert' WHEN 'purchase' THEN 'watch' ELSE 'clear' END AS state FROM obs), l AS (SELECT *, lag(state) OVER (PARTITION BY subject ORDER BY ts, id) AS p FROM s)
SELECT id, subject, state FROM l WHERE p IS NULL OR p <> state""")
def led_changes(spark, d):
    s = observations(spark, d).withColumn("state", F.when(F.col("kind") == "error", "alert").when(F.col("kind") == "purchase", "watch").otherwise("clear"))
    return windows.changes(s, ["subject"], ["ts", "id"], "state").select("id", "subject", "state")


@query("""+ c AS (SELECT kind, ts, id, k % 10 < 3 AS failed FROM obs), g AS (SELECT kind, coalesce(max((ts, id)) FILTER (NOT failed), (-1::DOUBLE, -1::BIGINT)) AS ok FROM c GROUP BY kind)
SELECT c.kind AS component, min(ts) FILTER (failed AND (ts, id) > ok) AS failing_since, count(*) FILTER (failed) AS failures FROM c JOIN g USING (kind) GROUP BY c.kind""")
def component_failing_since(spark, d):
    c = observations(spark, d).select("kind", "ts", "id", (F.col("k") % 10 < 3).alias("failed"))
    g = c.groupBy("kind").agg(F.max(F.when(~F.col("failed"), F.struct("ts", "id"))).alias("ok"))
    j = c.join(g, "kind")
    after = F.col("failed") & (F.col("ok").isNull() | (F.struct("ts", "id") > F.col("ok")))
    return j.groupBy(F.col("kind").alias("component")).agg(F.min(F.when(after, F.col("ts"))).alias("failing_since"), F.count_if("failed").alias("failures"))


@query("SELECT subject, array_to_string(list_sort(list(id)), ',') AS obs_ids FROM obs WHERE kind = 'error' GROUP BY subject")
def provenance_index(spark, d):
    g = observations(spark, d).where("kind = 'error'").groupBy("subject").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return g.select("subject", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("obs_ids"))


@query(f"""+ {_INC} SELECT incident_key, n, array_to_string(tl, ';') AS timeline FROM inc JOIN (SELECT kind || '|' || subject AS incident_key, list(k::VARCHAR ORDER BY ts, id) AS tl FROM obs GROUP BY 1) USING (incident_key)""")
def incident_detail_nested(spark, d):
    o = observations(spark, d)
    t = o.groupBy(F.concat_ws("|", "kind", F.col("subject").cast("string")).alias("incident_key")).agg(F.array_sort(F.collect_list(F.struct("ts", "id", "k"))).alias("t"))
    t = t.select("incident_key", F.array_join(F.transform("t", lambda x: x["k"].cast("string")), ";").alias("timeline"))
    return _incidents(spark, d).join(t, "incident_key").select("incident_key", "n", "timeline")


# ---- export, evaluation ------------------------------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT floor(ts / {DAY})::BIGINT AS cycle_id, max(ts) OVER (PARTITION BY floor(ts / {DAY})) AS clock_ts, id, ts, kind || ':' || subject AS row FROM obs")
def scenario_export_cycles(spark, d):
    """Every observation as a row of its cycle, with the cycle's clock."""
    o = observations(spark, d).select("id", "ts", F.concat_ws(":", "kind", F.col("subject").cast("string")).alias("row"))
    return sinks.scenario_rows(o, DAY)


@query(f"SELECT subject, (min(floor(ts / {DAY})) FILTER (kind = 'error'))::BIGINT AS first_cycle, (min(floor(ts / {DAY})) FILTER (kind = 'error') - min(floor(ts / {DAY})))::BIGINT AS latency FROM obs GROUP BY subject")
def eval_first_detection(spark, d):
    c = F.floor(F.col("ts") / DAY)
    g = observations(spark, d).groupBy("subject").agg(F.min(F.when(F.col("kind") == "error", c)).alias("first_cycle"), F.min(c).alias("start"))
    return g.select("subject", "first_cycle", (F.col("first_cycle") - F.col("start")).alias("latency"))


@query("""+ v AS (SELECT subject, bool_or(kind = 'error') AS detected, subject % 2 = 0 AS expected FROM obs GROUP BY subject) SELECT count(*) AS scenarios, count(*) FILTER (detected AND NOT expected) AS false_alerts, count(*) FILTER (expected AND NOT detected) AS missed, bool_and(detected = expected) AS pass FROM v""")
def eval_gates(spark, d):
    v = observations(spark, d).groupBy("subject").agg(F.bool_or(F.col("kind") == "error").alias("detected")).withColumn("expected", F.col("subject") % 2 == 0)
    return v.agg(F.count("*").alias("scenarios"), F.count_if(F.col("detected") & ~F.col("expected")).alias("false_alerts"), F.count_if(F.col("expected") & ~F.col("detected")).alias("missed"), F.bool_and(F.col("detected") == F.col("expected")).alias("pass"))


# ---- text --------------------------------------------------------------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(text, '(?i)\b([0-9a-f]{2}):([0-9a-f]{2}):[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:([0-9a-f]{2})\b', '\1:\2:xx:xx:xx:\3', 'g') AS text FROM (SELECT doc_id, text || ' AA:bb:CC:11:22:33 seen' AS text FROM documents)""", obs=False)
def redact_text(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" AA:bb:CC:11:22:33 seen")).alias("text"))
    return t.select("doc_id", C.mask_macs("text").alias("text"))


@query("SELECT DISTINCT source, 'ssid(len=' || length(source) || ',h=' || substr(sha1(source), 1, 4) || ')' AS token FROM documents", obs=False)
def ssid_token(spark, d):
    return table(spark, d, "documents").select("source").distinct().select("source", C.subject_token("source").alias("token"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '[<>\[\]`]', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents""", obs=False)
def neutral_evidence(spark, d):
    return table(spark, d, "documents").select("doc_id", C.neutral_text("text").alias("text"))


_MD = "text"
for _ch in C.MARKDOWN:
    _MD = f"replace({_MD}, '{_ch}', '\\{_ch}')"


@query(f"SELECT doc_id, md5({_MD}) AS escaped, length({_MD}) AS n FROM documents", obs=False)
def escape_markdown(spark, d):
    e = C.escape_markdown("text")
    return table(spark, d, "documents").select("doc_id", F.md5(e).alias("escaped"), F.length(e).cast("long").alias("n"))


# ---- whole-capture statistics -------------------------------------------------------------------------------------------------------------------------------------------------

_PER = """pe0 AS (SELECT subject, count(*) AS n, (max(ts) - min(ts)) / 3600 AS span_h, count(DISTINCT k) AS places, min(ts) AS first_ts, max(ts) AS last_ts FROM obs GROUP BY subject),
pe1 AS (SELECT *, CASE WHEN n >= 3 AND span_h >= 1 AND n / span_h >= 0.5 THEN least(n / span_h / 2, 1.0::DOUBLE) ELSE 0 END AS base FROM pe0), pe AS (SELECT *, round(CASE WHEN base > 0 AND places > 1 THEN least(base + 0.3::DOUBLE, 1.0::DOUBLE) ELSE base END, 6) AS score FROM pe1)"""


def _late(spark, d):
    return observations(spark, d)


@query(f"+ {_PER} SELECT subject, n, places, round(span_h, 6) AS span_h, score, score > 0.5 AS flagged FROM pe")
def legacy_persistence(spark, d):
    p = legacy_stats.persistence(_late(spark, d), "k")
    return p.select("subject", "n", "places", F.round("span_h", 6).alias("span_h"), "score", (F.col("score") > 0.5).alias("flagged"))


@query("""+ g AS (SELECT subject, ts, k, ts - lag(ts) OVER (PARTITION BY subject ORDER BY ts, id) AS gap FROM obs), s AS (SELECT subject, count(*) AS n, count(DISTINCT k) AS places, var_pop(gap) AS v FROM g GROUP BY subject)
SELECT count(*) AS subjects, round(avg((n >= 3)::INT), 6) AS persistence_rate, round(avg((places >= 2)::INT), 6) AS multi_location_rate, round(avg((n >= 3 AND v < 3600)::INT), 6) AS clustering,
(SELECT round(avg(CASE WHEN floor((floor(ts)::BIGINT % 86400) / 3600) >= 22 OR floor((floor(ts)::BIGINT % 86400) / 3600) <= 6 THEN 1 ELSE 0 END), 6) FROM obs) AS off_hours_rate, round(avg((places > 20)::INT), 6) AS probe_anomaly_rate FROM s""")
def legacy_statistics(spark, d):
    a = legacy_stats.gaps(_late(spark, d))
    h = legacy_stats.hour_of("ts")
    s = a.groupBy("subject").agg(F.count("*").alias("n"), F.countDistinct("k").alias("places"), F.var_pop("gap").alias("v"), F.sum(F.when((h >= 22) | (h <= 6), 1).otherwise(0)).alias("off"))
    r = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return s.agg(
        F.count("*").alias("subjects"), r(F.col("n") >= 3).alias("persistence_rate"), r(F.col("places") >= 2).alias("multi_location_rate"), r((F.col("n") >= 3) & (F.col("v") < 3600)).alias("clustering"),
        F.round(F.sum("off") / F.sum("n"), 6).alias("off_hours_rate"), r(F.col("places") > 20).alias("probe_anomaly_rate"),
    )


@query("""+ g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY subject ORDER BY ts, id) AS gap, floor((floor(ts)::BIGINT % 86400) / 3600) AS h, (floor(ts / 86400)::BIGINT + 3) % 7 AS wd FROM obs),
s AS (SELECT subject, count(*) AS n, round(avg((h BETWEEN 9 AND 17)::INT), 6) AS work_ratio, round(avg((h >= 22 OR h <= 6)::INT), 6) AS off_ratio, count(*) FILTER (wd < 5) AS wk, count(*) FILTER (wd >= 5) AS we, avg(gap) AS mg, var_pop(gap) AS vg FROM g GROUP BY subject)
SELECT subject, n, work_ratio, off_ratio, n >= 3 AND vg < 0.1 * mg AS regular, CASE WHEN wk > 2 * we THEN 'weekday' WHEN we > wk THEN 'weekend' ELSE 'mixed' END AS week FROM s""")
def legacy_temporal(spark, d):
    return legacy_stats.temporal(_late(spark, d))


@query("SELECT k, count(DISTINCT subject) AS subjects, count(*) AS n FROM obs GROUP BY k HAVING count(DISTINCT subject) >= 2")
def legacy_geographic(spark, d):
    return legacy_stats.hotspots(_late(spark, d), "k")


@query("""+ g AS (SELECT *, lag(k) OVER w AS p, ts - lag(ts) OVER w AS gap FROM obs WINDOW w AS (PARTITION BY subject ORDER BY ts, id)) SELECT subject, count(*) AS moves FROM g WHERE p <> k AND gap < 1800 GROUP BY subject""")
def legacy_quick_moves(spark, d):
    return legacy_stats.quick_moves(_late(spark, d), "k", 1800.0)


@query("SELECT a.subject, b.subject AS other, count(*) AS together FROM obs a JOIN obs b ON a.k = b.k AND a.subject < b.subject AND abs(a.ts - b.ts) < 3600 GROUP BY ALL HAVING count(*) >= 1")
def legacy_correlations(spark, d):
    return legacy_stats.correlations(_late(spark, d), "k", 3600.0, 1)


@query(f"+ {_PER}, st AS (SELECT *, round(CASE WHEN places >= 3 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN n >= 10 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN span_h >= 24 THEN 0.3::DOUBLE ELSE 0 END, 6) AS stalking FROM pe WHERE score >= 0) SELECT subject, n, places, stalking FROM st WHERE stalking >= 0.6")
def legacy_stalking(spark, d):
    return legacy_stats.stalking(legacy_stats.persistence(_late(spark, d), "k"), 0.0).select("subject", "n", "places", "stalking")


@query(f"+ {_PER} SELECT k, round(avg(score), 6) AS avg_score, max(score) AS max_score, count(*) AS subjects, least(greatest(50 * count(*), 100), 500) AS radius FROM (SELECT DISTINCT subject, k FROM obs) JOIN pe USING (subject) GROUP BY k")
def legacy_heatmap(spark, d):
    a = _late(spark, d)
    return legacy_stats.heatmap(legacy_stats.persistence(a, "k"), a, "k")


@query("SELECT 'net' || (k % 20) AS ssid, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM obs GROUP BY 1")
def legacy_probe_stats(spark, d):
    return legacy_stats.probe_stats(aps(spark, d), "ssid")


# ---- smaller operators -----------------------------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT coalesce({NOW} - max(ts) > 180, true) AS deaf, max(ts) AS last_ts FROM obs WHERE kind = 'error'")
def deaf_capture(spark, d):
    a = observations(spark, d).where("kind = 'error'").agg(F.max("ts").alias("last_ts"))
    return a.select(F.coalesce(NOW - F.col("last_ts") > 180, F.lit(True)).alias("deaf"), "last_ts")


@query("+ g AS (SELECT subject, ts, ts - lag(ts) OVER (PARTITION BY subject ORDER BY ts, id) AS gap FROM obs) SELECT subject, count(*) FILTER (gap > 90000) AS dropouts, max(gap) AS longest FROM g GROUP BY subject")
def gps_dropout(spark, d):
    g = legacy_stats.gaps(observations(spark, d))
    return g.groupBy("subject").agg(F.count_if(F.col("gap") > 90000).alias("dropouts"), F.max("gap").alias("longest"))


@query(f"""+ h AS (SELECT subject, max(ts) AS t, bool_or(kind = 'error' AND ts >= {NOW} - 172800) AS alert, bool_or(kind = 'purchase' AND ts >= {NOW} - 172800) AS watch, bool_or(k = 3) AS degraded FROM obs GROUP BY subject)
SELECT subject, CASE WHEN {NOW} - t > 200000 THEN 'fail' WHEN alert THEN 'alert' WHEN watch THEN 'watch' WHEN degraded THEN 'degraded' ELSE 'clear' END AS state FROM h""")
def effective_state(spark, d):
    recent = F.col("ts") >= NOW - 172800
    h = observations(spark, d).groupBy("subject").agg(
        F.max("ts").alias("t"), F.bool_or((F.col("kind") == "error") & recent).alias("alert"), F.bool_or((F.col("kind") == "purchase") & recent).alias("watch"), F.bool_or(F.col("k") == 3).alias("degraded")
    )
    return h.select("subject", C.state_of(NOW - F.col("t") > 200000, "alert", "watch", "degraded").alias("state"))


@query("SELECT kind, count(*) AS n, count(DISTINCT k) AS places FROM obs GROUP BY kind")
def observations_by_kind(spark, d):
    return observations(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("k").alias("places"))


@query("+ e AS (SELECT subject, min(ts) AS first_seen, count(*) AS see_count FROM obs GROUP BY subject) SELECT o.id AS seq, o.subject, o.kind, e.see_count FROM obs o JOIN e USING (subject) WHERE o.id > (SELECT max(id) * 0.9 FROM obs) ORDER BY seq")
def touched_since(spark, d):
    """Rows behind a sequence cursor with their entity."""
    o = observations(spark, d)
    cursor = o.agg((F.max("id") * 0.9).alias("c"))
    e = upserts.entities(o, ["subject"]).select("subject", "see_count")
    return o.join(F.broadcast(cursor), F.col("id") > F.col("c")).join(e, "subject").select(F.col("id").alias("seq"), "subject", "kind", "see_count").orderBy("seq")


@query(f"+ {_INC} SELECT incident_key, 1000 + row_number() OVER (ORDER BY coalesce(last_ts, 0), incident_key) AS updated_seq FROM inc WHERE severity = 'alert'")
def sequence_backfill(spark, d):
    """Sequence numbers behind the present maximum, in order of time."""
    i = _incidents(spark, d).where("severity = 'alert'").withColumn("at", F.coalesce("last_ts", F.lit(0.0)))
    r = windows.global_rank(i, "at", DAY, ["incident_key"], "nr")
    return r.select("incident_key", (F.col("nr") + 1000).alias("updated_seq"))


@query(f"""+ {_DE} SELECT target, source, count(*) AS n FROM de WHERE target IN (2, 3, 5, 8) OR target = (SELECT max(target) FROM de) GROUP BY ALL HAVING count(*) >= 2""")
def protected_attacks(spark, d):
    """Attacks on protected devices or the broadcast target (Z20); the highest subject stands for broadcast."""
    e = deauths(spark, d)
    protected = spark.createDataFrame([(i,) for i in (2, 3, 5, 8)], "target long").unionByName(e.agg(F.max("target").alias("target")))
    return e.join(protected.distinct(), "target", "left_semi").groupBy("target", "source").agg(F.count("*").alias("n")).where("n >= 2")


@query(f"""+ {_RATE}, sv AS (SELECT target, source, n, CASE WHEN rate > 0.005 OR (target < 40 AND n > 20) THEN 0 WHEN rate > 0.002 OR (target < 40 AND n > 10) THEN 1 WHEN rate > 0.001 OR n > 20 THEN 2 ELSE 3 END AS o FROM rates)
SELECT target, source, n, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][o + 1] AS severity FROM sv ORDER BY o, target, source LIMIT 20""")
def attack_filings(spark, d):
    a = radio.attack_severity(radio.peak_rates(deauths(spark, d), 86400), 0.001, F.col("target") < 40)
    return radio.first_filings(a).select("target", "source", "n", "severity")


@query(f"""+ {_RATE}, sv AS (SELECT target, source, n, CASE WHEN rate > 0.005 OR (target < 40 AND n > 20) THEN 0 WHEN rate > 0.002 OR (target < 40 AND n > 10) THEN 1 WHEN rate > 0.001 OR n > 20 THEN 2 ELSE 3 END AS o FROM rates)
SELECT target, source, n, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][o + 1] AS severity FROM sv ORDER BY o DESC, target DESC, source DESC LIMIT 20""")
def attack_filings_last(spark, d):
    a = radio.attack_severity(radio.peak_rates(deauths(spark, d), 86400), 0.001, F.col("target") < 40)
    return radio.first_filings(a, last=True).select("target", "source", "n", "severity")


@query(f"+ {_RATE}, sv AS (SELECT CASE WHEN rate > 0.005 OR (target < 40 AND n > 20) THEN 'CRITICAL' WHEN rate > 0.002 OR (target < 40 AND n > 10) THEN 'HIGH' WHEN rate > 0.001 OR n > 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM rates) SELECT severity, count(*) AS n FROM sv GROUP BY severity")
def severity_counts(spark, d):
    a = radio.attack_severity(radio.peak_rates(deauths(spark, d), 86400), 0.001, F.col("target") < 40)
    return a.groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT upper(trim(c_name)) AS subject FROM customer WHERE trim(c_name) <> ''", obs=False)
def ignore_list_generate(spark, d):
    from skysift.sources.sinks import generate_ignore_list

    return generate_ignore_list(table(spark, d, "customer").select(F.col("c_name").alias("devmac")))


@query("SELECT s_suppkey, upper(trim(split_part('  aa:' || s_suppkey || '/24', '/', 1))) AS mac FROM supplier", obs=False)
def mac_normalize(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", C.normalize_mac(F.concat(F.lit("  aa:"), F.col("s_suppkey").cast("string"), F.lit("/24"))).alias("mac"))


@query("""SELECT n_nationkey, i::INTEGER AS i, round(33.4::DOUBLE + n_nationkey * 0.01::DOUBLE + (100 + 10 * n_regionkey) / 111000 * sin(radians(10 * i)), 9) AS lat,
round(-112.0::DOUBLE + (100 + 10 * n_regionkey) / 111000 * cos(radians(10 * i)), 9) AS lon FROM nation, (SELECT unnest(range(0, 37)) AS i)""", obs=False)
def circle_polygon(spark, d):
    """37 points around each place, at its radius."""
    n = table(spark, d, "nation").withColumn("lat", F.lit(33.4) + F.col("n_nationkey") * F.lit(0.01))
    ring = n.select("n_nationkey", F.posexplode(C.circle("lat", F.lit(-112.0), 100 + 10 * F.col("n_regionkey"))).alias("i", "p"))
    return ring.select("n_nationkey", "i", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


@query("""+ x AS (SELECT subject, array_to_string(list_sort(list(id)), ',') AS ids FROM obs WHERE kind = 'error' GROUP BY subject) SELECT c.subject, c.kind, CASE WHEN c.k = 0 THEN 'own' ELSE coalesce(x.ids, '') END AS obs_ids FROM obs c LEFT JOIN x USING (subject) WHERE c.kind = 'signup'""")
def attach_obs_ids(spark, d):
    """Provenance fills only lines that have none."""
    o = observations(spark, d)
    x = o.where("kind = 'error'").groupBy("subject").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    c = o.where("kind = 'signup'").withColumn("own", F.when(F.col("k") == 0, F.lit("own"))).join(x, "subject", "left")
    return c.select("subject", "kind", F.coalesce("own", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit("")).alias("obs_ids"))


@query(f"""+ {_VIEWS} SELECT key_a, key_b, round(len(list_intersect(a.ssids, b.ssids)) / len(list_distinct(a.ssids || b.ssids)), 6) AS jaccard FROM pr JOIN vw a ON a.key = key_a JOIN vw b ON b.key = key_b WHERE shared >= 3""")
def ssid_jaccard(spark, d):
    return _jaccards(_views(spark, d))


def _jaccards(v):
    p = identity.shared_counts(v.select("key", "ssids")).where("shared >= 3")
    return p.select("key_a", "key_b", F.round(F.col("shared") / (F.col("sizes") - F.col("shared")), 6).alias("jaccard"))


@query("""+ g AS (SELECT k, list_sort(list(DISTINCT subject) FILTER (kind = 'view')) AS a, list_sort(list(DISTINCT subject) FILTER (kind = 'click')) AS b FROM obs GROUP BY k) SELECT k, coalesce(a, []) = coalesce(b, []) AS same FROM g""")
def entity_set_equality(spark, d):
    return _same_sets(observations(spark, d))


def _same_sets(o):
    g = o.groupBy("k").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("subject")))).alias(n) for k, n in (("view", "a"), ("click", "b"))))
    return g.select("k", (F.col("a") == F.col("b")).alias("same"))


@query(f"+ {_INC} SELECT incident_key, CASE WHEN last_ts < {NOW} - 5 * {DAY} THEN 'closed' ELSE 'open' END AS status FROM inc")
def stale_close(spark, d):
    status = F.when(F.col("last_ts") < NOW - 5 * DAY, "closed").otherwise("open")
    return _incidents(spark, d).select("incident_key", status.alias("status"))


@query(f"+ {_INC}, old AS (SELECT incident_key FROM inc WHERE last_ts < {NOW} - 7 * {DAY}) SELECT id FROM obs WHERE kind || '|' || subject IN (SELECT incident_key FROM old)")
def child_purge(spark, d):
    """Children of purged parents."""
    old = _incidents(spark, d).where(F.col("last_ts") < NOW - 7 * DAY).select("incident_key")
    o = observations(spark, d).withColumn("incident_key", F.concat_ws("|", "kind", F.col("subject").cast("string")))
    return o.join(old, "incident_key", "left_semi").select("id")


@query(f"""+ {_DE}, x AS (SELECT target, source, list(DISTINCT id) AS ids FROM de GROUP BY ALL HAVING count(*) >= 3) SELECT target, source, array_to_string(list_sort(ids), ',') AS obs_ids FROM x""")
def attack_obs_ids(spark, d):
    g = deauths(spark, d).groupBy("target", "source").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") >= 3)
    return g.select("target", "source", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("obs_ids"))


@query(f"""+ {_LINK}, ro AS (SELECT unnest(range(0, 12)) AS key) SELECT a.key AS key_a, b.key AS key_b, confidence FROM ro a JOIN ro b ON a.key < b.key JOIN ls ON key_a = a.key AND key_b = b.key WHERE together OR confidence >= 0.3""")
def roster_links(spark, d):
    """Standing hypotheses between all pairs of a roster."""
    o = observations(spark, d).where(F.col("subject").between(0, 11)).withColumn("tag", F.col("k") % 8)
    return _roster(spark, identity.views(o, "subject", "k", "tag", True))


def _roster(spark, v):
    """Only the roster's own views are paired."""
    h = identity.links(v.join(spark.range(12), v.key == F.col("id"), "left_semi"))
    return h.select("key_a", "key_b", "confidence")


@query("SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')) AS escaped FROM documents", obs=False)
def escape_xml(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(C.escape_xml("text")).alias("escaped"))


@query(f"""+ {_CL}, g AS (SELECT *, CASE WHEN lag(k) OVER w IS DISTINCT FROM k OR ts - lag(ts) OVER w > 600 THEN 1 ELSE 0 END AS nw FROM cl WINDOW w AS (PARTITION BY subject ORDER BY ts, lat, lon)),
v0 AS (SELECT *, sum(nw) OVER (PARTITION BY subject ORDER BY ts, lat, lon ROWS UNBOUNDED PRECEDING) AS visit FROM g) SELECT subject, visit::BIGINT AS session, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM v0 GROUP BY subject, visit""")
def legacy_location_sessions(spark, d):
    """Sessions at places of 100 m, ten minutes apart."""
    o = observations(spark, d)
    c = geo.assign_clusters(o.select("subject", "ts", "lat", "lon"), 100.0)
    w = Window.partitionBy("subject").orderBy("ts", "lat", "lon")
    new = (F.lag("cluster").over(w) != F.col("cluster")) | (F.col("ts") - F.lag("ts").over(w) > 600)
    s = windows.islands(c.withColumn("_b", new), ["subject"], ["ts", "lat", "lon"], F.col("_b"), "session")
    return s.groupBy("subject", "session").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"))


@query(f"""+ s AS (SELECT unnest([{NOW}, {NOW} - 3600]) AS now), b AS (SELECT now, unnest([5, 10, 15, 20, 2]) AS m FROM s) SELECT now, m::INTEGER AS minutes, now - 60 * m AS boundary FROM b""")
def time_boundaries(spark, d):
    s = spark.createDataFrame([(NOW,), (NOW - 3600,)], "now double").select("now", F.explode(F.array(*(F.lit(m) for m in (5, 10, 15, 20, 2)))).alias("minutes"))
    return s.withColumn("boundary", F.col("now") - 60 * F.col("minutes"))


@query(f"""+ b AS (SELECT subject, floor(ts / {DAY})::BIGINT AS batch, max(k) AS top FROM obs GROUP BY ALL) SELECT subject, batch, top, max(top) OVER (PARTITION BY subject ORDER BY batch) AS cursor FROM b""")
def cursor_advance(spark, d):
    """After each batch the cursor is the highest number consumed so far; a batch of lower ones never takes it back."""
    b = observations(spark, d).groupBy("subject", F.floor(F.col("ts") / DAY).cast("long").alias("batch")).agg(F.max("k").alias("top"))
    return incidents.cursors(b, ["subject"], "batch", "top")


from skysift.plans import capture_catalog, store_catalog, stream_catalog  # noqa: E402, F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
