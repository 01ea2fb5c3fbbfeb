"""Raw device, alert, GPS and Bluetooth rows to one observation shape; nested-JSON features by Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.columns import AP_KEYWORDS, BLE_HINTS, DEAUTH_KEYWORDS, channel_of, contains_any, finite, first_of, normalize_mac

#: The observation log. payload is JSON text with sorted keys; reject says why a row is not one.
COLUMNS = ["ts", "source", "kind", "identity_key", "lat", "lon", "accuracy_m", "payload_json", "session_id"]


def at(blob: Column, *keys: str, kind: str = "string") -> Column:
    """A path of keys that may hold dots, from a VARIANT."""
    return F.try_variant_get(blob, "$" + "".join(f'["{k}"]' for k in keys), kind)


def _payload(**fields: Column) -> Column:
    """JSON of the fields that are not null, in the order of their names."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "true"})


def geopoint(blob: Column, now: Column, row_ts: Column) -> tuple[Column, Column, Column]:
    """(lat, lon, ts) of a device's last place; the raw point is [lon, lat]. The stamp is the place's, else the device's, the row's, or now."""
    loc = ("kismet.device.base.location",)
    point = lambda i: F.try_variant_get(blob, f'$["kismet.device.base.location"]["kismet.common.location.geopoint"][{i}]', "double")
    lat, lon = finite(point(1)), finite(point(0))
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ((F.abs(lat) >= 1e-4) | (F.abs(lon) >= 1e-4))
    stamp = F.coalesce(F.nullif(at(blob, *loc, "kismet.common.location.time_sec", kind="double"), F.lit(0.0)), F.nullif(at(blob, "kismet.device.base.last_time", kind="double"), F.lit(0.0)), row_ts, now)
    return F.when(ok, lat), F.when(ok, lon), F.when(ok, stamp)


def devices(rows: DataFrame, session_id: str, now: float) -> DataFrame:
    """devices (devmac, type, device, last_time) -> observations with reject; malformed JSON keeps the row, without its payload."""
    v = F.try_parse_json("device")
    key, ts = normalize_mac(F.coalesce(F.nullif(F.col("devmac"), F.lit("")), at(v, "kismet.device.base.macaddr"))), finite("last_time")
    lat, lon, _ = geopoint(v, F.lit(now), ts)
    payload = _payload(
        rssi=at(v, "kismet.device.base.signal", "kismet.common.signal.last_signal", kind="long"), channel=at(v, "kismet.device.base.channel"),
        frequency=at(v, "kismet.device.base.frequency", kind="double"), type=first_of("type", at(v, "kismet.device.base.type")),
        commonname=at(v, "kismet.device.base.commonname"), manuf=at(v, "kismet.device.base.manuf"),
    )
    return rows.select(
        ts.alias("ts"), F.lit("kismet.devices").alias("source"), F.when(contains_any("type", ["btle", "bluetooth"]), "ble_adv").otherwise("wifi_device").alias("kind"),
        key.alias("identity_key"), lat.alias("lat"), lon.alias("lon"), F.lit(None).cast("double").alias("accuracy_m"), payload.alias("payload_json"), F.lit(session_id).alias("session_id"),
        F.when(key.isNull(), "no identity").when(ts.isNull(), "no time").alias("reject"),
    )


def alerts(rows: DataFrame, session_id: str) -> DataFrame:
    """alerts (ts_sec, header, json, src_mac, dst_mac, bssid) -> observations; the kind goes by keywords of header and text."""
    v = F.try_parse_json("json")
    header, text = first_of("header", at(v, "kismet.alert.header")), F.coalesce(at(v, "kismet.alert.text"), F.lit(""))
    source = first_of("src_mac", at(v, "kismet.alert.source_mac"), at(v, "kismet.alert.src_mac"), at(v, "kismet.alert.tx_mac"))
    target = first_of("dst_mac", at(v, "kismet.alert.dest_mac"))
    deauth = contains_any(F.coalesce(header, F.lit("")), DEAUTH_KEYWORDS) | contains_any(text, DEAUTH_KEYWORDS)
    ts = finite("ts_sec")
    return rows.select(
        ts.alias("ts"), F.lit("kismet.alerts").alias("source"), F.when(deauth, "deauth_alert").otherwise("kismet_alert").alias("kind"), normalize_mac(F.coalesce(source, target)).alias("identity_key"),
        *(F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "accuracy_m")),
        _payload(header=header, text=text, source=normalize_mac(source), target=normalize_mac(target), bssid=normalize_mac("bssid"), channel=at(v, "kismet.alert.channel")).alias("payload_json"),
        F.lit(session_id).alias("session_id"), F.when(ts.isNull(), "no time").when(F.coalesce(source, target).isNull(), "no identity").alias("reject"),
    )


def gps_fixes(rows: DataFrame, session_id: str) -> DataFrame:
    """fixes (lat, lon, ts, accuracy_m) -> observations of the operator; out-of-range fixes are rejected."""
    lat, lon, ts = finite("lat"), finite("lon"), finite("ts")
    return rows.select(
        ts.alias("ts"), F.lit("gps").alias("source"), F.lit("gps_fix").alias("kind"), F.lit("operator").alias("identity_key"), lat.alias("lat"), lon.alias("lon"), finite("accuracy_m").alias("accuracy_m"),
        F.lit("{}").alias("payload_json"), F.lit(session_id).alias("session_id"),
        F.when(ts.isNull(), "no time").when(~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)), "no place").alias("reject"),
    )


def ble_advertisements(rows: DataFrame, session_id: str) -> DataFrame:
    """advertisements (mac, ts, rssi) -> observations."""
    key, ts = normalize_mac("mac"), finite("ts")
    return rows.select(
        ts.alias("ts"), F.lit("ble").alias("source"), F.lit("ble_adv").alias("kind"), key.alias("identity_key"), *(F.lit(None).cast("double").alias(c) for c in ("lat", "lon", "accuracy_m")),
        _payload(rssi=finite("rssi")).alias("payload_json"), F.lit(session_id).alias("session_id"), F.when(key.isNull(), "no identity").when(ts.isNull(), "no time").alias("reject"),
    )


def split_rejects(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rejected rows): malformed rows are set aside, never fatal."""
    return normalized.where("reject is null").select(*COLUMNS), normalized.where("reject is not null")


def canonical(obj) -> str:
    return json.dumps(obj, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _walk(obj, tags: set, caps: set, ssids: set, path: str = "") -> None:
    if isinstance(obj, dict):
        for k, x in obj.items():
            low = str(k).lower()
            if "ssid" in low and low.endswith(".ssid") and isinstance(x, str) and x:
                ssids.add(x)
            if "ie_tag" in low or low.endswith("tag_list"):
                tags.update(int(t) for t in (x if isinstance(x, list) else [x]) if isinstance(t, (int, float)) and not isinstance(t, bool))
            if "capabilit" in low and isinstance(x, (str, int)):
                caps.add(f"{low}={x}")
            _walk(x, tags, caps, ssids, low)
    elif isinstance(obj, list):
        for x in obj:
            _walk(x, tags, caps, ssids, path)


def features(blobs: DataFrame, column: str = "device") -> DataFrame:
    """Adds digest (sha256 of the canonical JSON), ssids, ie_tags (64 at most), caps (40 at most) and fingerprint of a JSON column.

    Depth and key names are open, so the walk is an Arrow-batched Python pass; malformed JSON gives nulls."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column(column).to_pylist():
                try:
                    obj = json.loads(text)
                except (TypeError, ValueError):
                    for o in out:
                        o.append(None)
                    continue
                tags, caps, ssids = set(), set(), set()
                _walk(obj, tags, caps, ssids)
                t, c = sorted(tags)[:64], sorted(caps)[:40]
                mark = hashlib.sha256(canonical({"caps": c, "tags": t}).encode()).hexdigest() if t or c else None
                for o, v in zip(out, (hashlib.sha256(canonical(obj).encode()).hexdigest(), sorted(ssids), t, c, mark)):
                    o.append(v)
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(o, k) for o, k in zip(out, kinds))], names=[*b.schema.names, "digest", "ssids", "ie_tags", "caps", "fingerprint"])

    return blobs.mapInArrow(run, f"{schema}, digest string, ssids array<string>, ie_tags array<bigint>, caps array<string>, fingerprint string")


def ap_sightings(rows: DataFrame) -> DataFrame:
    """devices -> (bssid, ssid, ts, encryption): advertised networks exploded; the map may be a list or an object."""
    v = F.try_parse_json("device")
    one = "struct<`dot11.advertisedssid.ssid`:string,`dot11.advertisedssid.crypt_string`:string>"
    raw = F.to_json(F.try_variant_get(v, '$["dot11.device"]["dot11.device.advertised_ssid_map"]', "variant"))
    as_list, as_map = F.from_json(raw, f"array<{one}>"), F.map_values(F.from_json(raw, f"map<string,{one}>"))
    nets = F.when(F.startswith(raw, F.lit("[")), as_list).otherwise(as_map)
    d = rows.select(normalize_mac("devmac").alias("bssid"), finite("last_time").alias("ts"), F.explode(nets).alias("n"))
    return d.select("bssid", "ts", F.col("n").getField("dot11.advertisedssid.ssid").alias("ssid"), F.coalesce(F.col("n").getField("dot11.advertisedssid.crypt_string"), F.lit("OPEN")).alias("encryption")).where("ssid is not null and ssid <> ''")


def retry_events(devices_: DataFrame) -> DataFrame:
    """devices -> (ts, target, source, retries, tx): clients whose retries are above half of their frames and above fifty, from each device's client map."""
    v = F.try_parse_json("device")
    one = "struct<`dot11.client.retries`:double,`dot11.client.tx_packets`:double>"
    clients = F.from_json(F.to_json(F.try_variant_get(v, '$["dot11.device"]["dot11.device.client_map"]', "variant")), f"map<string,{one}>")
    d = devices_.select(finite("last_time").alias("ts"), F.upper("devmac").alias("target"), F.explode(clients).alias("source", "c"))
    d = d.select("ts", "target", F.coalesce(F.nullif(F.upper("source"), F.lit("")), F.lit("UNKNOWN")).alias("source"), F.col("c").getField("dot11.client.retries").alias("retries"), F.col("c").getField("dot11.client.tx_packets").alias("tx"))
    return d.where((F.col("tx") > 0) & (F.col("retries") > 50) & (F.try_divide("retries", "tx") > 0.5))


def ap_alerts(alerts_: DataFrame) -> DataFrame:
    """alerts (ts_sec, header, json) -> (ts, ssid, rogue_bssid, severity, reason) of those that speak of access points."""
    v = F.try_parse_json("json")
    kind = F.coalesce(at(v, "kismet.alert.header"), F.col("header"), F.lit(""))
    text = F.coalesce(at(v, "kismet.alert.text"), F.col("header"), F.lit(""))
    source = F.upper(F.coalesce(at(v, "kismet.alert.source_mac"), F.lit("UNKNOWN")))
    hit = contains_any(kind, AP_KEYWORDS) | contains_any(text, AP_KEYWORDS)
    return alerts_.where(hit).select(F.col("ts_sec").alias("ts"), F.concat(F.lit("[Kismet Alert: "), kind, F.lit("]")).alias("ssid"), source.alias("rogue_bssid"), F.lit("HIGH").alias("severity"), F.concat(F.lit("Kismet alert: "), F.substring(text, 1, 200)).alias("reason"))


def network_sets(rows: DataFrame) -> DataFrame:
    """(bssid, ts, ssids, channel): advertised and responded networks of each device as one set, and its channel, by frequency where it names none."""
    v = F.try_parse_json("device")

    def names(map_: str, field: str) -> Column:
        raw = F.to_json(F.try_variant_get(v, f'$["dot11.device"]["{map_}"]', "variant"))
        one = f"struct<`{field}`:string>"
        nets = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, f"array<{one}>")).otherwise(F.map_values(F.from_json(raw, f"map<string,{one}>")))
        return F.coalesce(F.filter(F.transform(nets, lambda n: n.getField(field)), lambda s: s != ""), F.array().cast("array<string>"))

    both = F.array_union(names("dot11.device.advertised_ssid_map", "dot11.advertisedssid.ssid"), names("dot11.device.responded_ssid_map", "dot11.advertisedssid.ssid"))
    channel = F.coalesce(at(v, "kismet.device.base.channel").try_cast("int"), channel_of(at(v, "kismet.device.base.frequency", kind="double")))
    return rows.select(normalize_mac("devmac").alias("bssid"), finite("last_time").alias("ts"), F.array_sort(both).alias("ssids"), channel.alias("channel"))


def is_ble(type_: Column, device: Column) -> Column:
    """A Bluetooth device by its type, or by a key of its metadata."""
    return F.coalesce(contains_any(type_, BLE_HINTS), F.lit(False)) | F.coalesce(F.lower(device).rlike(r'"[^"]*(btle|bluetooth)[^"]*"\s*:'), F.lit(False))


#: Keys whose values are subjects themselves.
SUBJECT_KEYS = {"ssid", "name", "devicename", "commonname", "manuf", "manufacturer"}


def _plain_token(x: str) -> str:
    return f"ssid(len={len(x)},h={hashlib.sha1(x.encode()).hexdigest()[:4]})" if x else "?"


def _plain_text(x: str) -> str:
    x = re.sub(r"(?i)\b([0-9a-f]{2}):([0-9a-f]{2}):[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:([0-9a-f]{2})\b", r"\1:\2:xx:xx:xx:\3", x)
    return " ".join(re.sub("[\x00-\x1f\x7f-\x9f\u200b-\u200f\u202a-\u202e\u2028\u2029\ufeff<>\\[\\]`]", " ", x).split())


def _redacted(obj):
    if isinstance(obj, str):
        return _plain_text(obj)
    if isinstance(obj, dict):
        return {k: _plain_token(x) if k in SUBJECT_KEYS and isinstance(x, str) else _redacted(x) for k, x in obj.items()}
    return [_redacted(x) for x in obj] if isinstance(obj, list) else obj


def redact_json(rows: DataFrame, column: str) -> DataFrame:
    """Every string of a JSON column neutralised at any depth, subjects replaced by their token; text that is no JSON becomes null. Depth is open, so this
    is an Arrow-batched Python pass."""

    def one(text: str | None) -> str | None:
        try:
            return canonical(_redacted(json.loads(text)))
        except (TypeError, ValueError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.names.index(column)
            yield b.set_column(i, column, pa.array([one(x) for x in b.column(i).to_pylist()], pa.string()))

    return rows.mapInArrow(run, rows.schema)
