"""Queries over capture tables made of the sample sightings: ranges and normalizers, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.operators import normalize
from skysift.plans.catalog import DAY, NOW, query
from skysift.sources import captures
from skysift.sources.bindings import observations

#: Of the sightings a tenth has no address, a tenth has one with a mask, a fourth has a place and a channel in its blob, a fourth a broken blob, some no time.
_DV = f"""dv AS (SELECT id, k, CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 1 THEN ' d' || subject || '/ff:ff ' ELSE 'd' || subject END AS devmac, CASE WHEN k % 3 = 0 THEN 'BTLE Device' ELSE 'Wi-Fi AP' END AS type, CASE WHEN k % 13 <> 0 THEN ts END AS last_time, subject, lat, lon FROM obs)"""


def _devices(spark, d):
    o, k, name = observations(spark, d), F.col("k"), F.concat(F.lit("d"), F.col("subject").cast("string"))
    text = lambda c: F.col(c).cast("string")
    place = F.concat(F.lit('{"kismet.device.base.channel":"'), (k % 11).cast("string"), F.lit('","kismet.device.base.location":{"kismet.common.location.geopoint":['), text("lon"), F.lit(","), text("lat"), F.lit("]}}"))
    blob = F.when(k % 4 == 0, place).when(k % 4 == 1, "{bad").when(k % 4 == 2, F.concat(F.lit('{"kismet.device.base.macaddr":"m'), text("subject"), F.lit('"}'))).otherwise("{}")
    return o.select(
        "id", "k", F.when(k % 10 == 0, "").when(k % 10 == 1, F.concat(F.lit(" "), name, F.lit("/ff:ff "))).otherwise(name).alias("devmac"), F.when(k % 3 == 0, "BTLE Device").otherwise("Wi-Fi AP").alias("type"),
        blob.alias("device"), F.when(k % 13 != 0, F.col("ts")).alias("last_time"),
    )


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@query(f"""+ {_DV}, nz AS (SELECT *, CASE WHEN k % 10 <> 0 THEN 'D' || subject WHEN k % 4 = 2 THEN 'M' || subject END AS key FROM dv)
SELECT last_time AS ts, CASE WHEN k % 3 = 0 THEN 'ble_adv' ELSE 'wifi_device' END AS kind, key AS identity_key, CASE WHEN k % 4 = 0 THEN round(lat, 6) END AS lat, CASE WHEN k % 4 = 0 THEN round(lon, 6) END AS lon,
'{{' || CASE WHEN k % 4 = 0 THEN '"channel":"' || k % 11 || '",' ELSE '' END || '"type":"' || type || '"}}' AS payload_json, CASE WHEN key IS NULL THEN 'no identity' WHEN last_time IS NULL THEN 'no time' END AS reject FROM nz""")
def device_observations(spark, d):
    """Device rows as observations, what is wrong with the others beside them."""
    return _rounded(normalize.devices(_devices(spark, d), "s", NOW)).select("ts", "kind", "identity_key", "lat", "lon", "payload_json", "reject")


@query("SELECT CASE WHEN k % 13 <> 0 THEN ts END AS ts, 'operator' AS identity_key, round(lat + CASE WHEN k % 7 = 0 THEN 90 ELSE 0 END, 6) AS lat, round(lon, 6) AS lon, k::DOUBLE AS accuracy_m, CASE WHEN k % 13 = 0 THEN 'no time' WHEN k % 7 = 0 THEN 'no place' END AS reject FROM obs")
def gps_fix_observations(spark, d):
    """The operator's fixes as observations; those off the earth are rejected."""
    k = F.col("k")
    fixes = observations(spark, d).select((F.col("lat") + F.when(k % 7 == 0, 90).otherwise(0)).alias("lat"), "lon", F.when(k % 13 != 0, F.col("ts")).alias("ts"), k.cast("double").alias("accuracy_m"))
    return _rounded(normalize.gps_fixes(fixes, "s")).select("ts", "identity_key", "lat", "lon", "accuracy_m", "reject")


@query("""SELECT ts, CASE WHEN k % 10 <> 0 THEN 'B' || subject END AS identity_key, CASE WHEN k % 5 = 0 THEN '{}' ELSE '{"rssi":' || -k || '.0}' END AS payload_json, CASE WHEN k % 10 = 0 THEN 'no identity' END AS reject FROM obs""")
def ble_observations(spark, d):
    """Bluetooth advertisements as observations."""
    k = F.col("k")
    heard = observations(spark, d).select(F.when(k % 10 != 0, F.concat(F.lit("b"), F.col("subject").cast("string"))).alias("mac"), "ts", F.when(k % 5 != 0, (-k).cast("string")).otherwise("weak").alias("rssi"))
    return normalize.ble_advertisements(heard, "s").select("ts", "identity_key", "payload_json", "reject")


@query(f"+ {_DV} SELECT id, last_time FROM dv WHERE last_time >= {NOW} - 9 * {DAY} AND last_time <= {NOW} - 2 * {DAY}")
def device_range(spark, d):
    """Device rows of a time range that is closed at both ends (S3)."""
    return captures.devices_between(_devices(spark, d), NOW - 9 * DAY, NOW - 2 * DAY).select("id", "last_time")


@query(f"+ {_DV} SELECT devmac, count(*) AS n FROM dv WHERE last_time >= {NOW} - 9 * {DAY} GROUP BY devmac")
def address_range(spark, d):
    """Addresses seen since a time."""
    return captures.macs_between(_devices(spark, d), NOW - 9 * DAY).groupBy("devmac").agg(F.count("*").alias("n"))
