"""One-shot scans of a capture: deauthentication and rogue access points, from tables to filed attacks and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.functions.columns import DEAUTH_KEYWORDS, contains_any, finite, normalize_mac
from skysift.operators import normalize, radio
from skysift.sources.captures import devices_between


def deauth_scan(alerts: DataFrame, devices: DataFrame, now: float, window: float = 1800.0, least: int = 5, seconds: int = 60, burst: float = 10.0, protected: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(attacks, interference): attacks of the window with rate, severity and type, protected targets or the broadcast one only if any are named; and
    clients with suspicious retries."""
    v = F.try_parse_json("json")
    text = F.concat_ws(" ", F.coalesce(normalize.at(v, "kismet.alert.header"), "header"), F.coalesce(normalize.at(v, "kismet.alert.text"), "header"))
    events = alerts.where(contains_any(text, DEAUTH_KEYWORDS)).select(
        finite("ts_sec").alias("ts"), normalize_mac(F.coalesce(F.nullif("dst_mac", F.lit("")), normalize.at(v, "kismet.alert.dest_mac"), F.lit("FF:FF:FF:FF:FF:FF"))).alias("target"),
        F.coalesce(normalize_mac(F.coalesce(F.nullif("src_mac", F.lit("")), normalize.at(v, "kismet.alert.source_mac"))), F.lit("UNKNOWN")).alias("source"), normalize.at(v, "kismet.alert.channel").try_cast("int").alias("channel"),
    ).where((F.col("ts") >= now - window) & (F.col("ts") <= now))
    if protected:
        events = events.where(F.col("target").isin([*(m.upper() for m in protected), "FF:FF:FF:FF:FF:FF"]))
    found = radio.attacks(events, now, window, least)
    rates = radio.peak_rates(events, seconds).select("target", "source", "rate")
    guarded = F.col("target").isin([m.upper() for m in protected]) if protected else F.lit(False)
    return radio.attack_severity(found.join(rates, ["target", "source"]), burst, guarded), normalize.retry_events(devices_between(devices, now - window, now))


def rogue_scan(devices: DataFrame, alerts: DataFrame, now: float, trusted: DataFrame | None = None, window: float = 1800.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new radios of known networks, radios of trusted networks with a verdict, alerts that speak of access points)."""
    seen = normalize.network_sets(devices_between(devices, now - window, now)).withColumn("ssid", F.explode("ssids"))
    checked = radio.trusted_check(seen.select("ssid", "bssid", "channel"), trusted) if trusted is not None else seen.limit(0).select("ssid", "bssid")
    return radio.new_radios(seen).where("nth > 1"), checked, normalize.ap_alerts(alerts.where((F.col("ts_sec") >= now - window) & (F.col("ts_sec") <= now)))
