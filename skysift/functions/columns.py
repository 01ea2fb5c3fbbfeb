"""Scalar functions as column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EARTH_M = 6371000.0

#: Keywords and patterns that results depend on.
DEAUTH_KEYWORDS = ["deauth", "disassoc", "deauthentication", "disassociation", "deauthflood", "bssflood", "apspoof", "changehostname"]
AP_KEYWORDS = ["apspoof", "bsstimestamp", "probechan", "beaconchange", "cryptodrop", "advcryptchange", "wmmtspec", "dot11_ssid_new"]
TRACKER_NAMES = "(?i)(airtag|tile|smarttag|smart.?tag|galaxy.?smarttag|chipolo|eufy|trackr|pebblebee)"
BLE_HINTS = ["btle", "bluetooth", "bt device", "ble device"]
STRENGTHS = {"OPEN": 0, "WEP": 1, "WPA": 2, "WPA2": 3, "WPA3": 4}
MAC = r"(?i)\b([0-9a-f]{2}):([0-9a-f]{2}):[0-9a-f]{2}:[0-9a-f]{2}:[0-9a-f]{2}:([0-9a-f]{2})\b"
#: Characters that a backslash goes before in Markdown, the backslash first.
MARKDOWN = "\\`[]<>&"
DANGEROUS = "<>\"'&;|`$(){}[]"
SQL_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "UNION", "EXEC", "SCRIPT"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres, arctangent form."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp, dl = F.radians(_c(lat2) - _c(lat1)), F.radians(_c(lon2) - _c(lon1))
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), F.lit(2.0))
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def rough_metres(lat1, lon1, lat2, lon2) -> Column:
    """Straight distance of degrees at 111 km each."""
    return F.sqrt(F.pow(_c(lat1) - _c(lat2), F.lit(2.0)) + F.pow(_c(lon1) - _c(lon2), F.lit(2.0))) * 111000


def circle(lat, lon, radius_m, points: int = 36) -> Column:
    """A closed ring of (lat, lon) around a place, from the east on, at 111 km a degree both ways."""
    r = _c(radius_m) / 111000
    angle = lambda i: F.radians(i * (360 / points))
    return F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.struct((_c(lat) + r * F.sin(angle(i))).alias("lat"), (_c(lon) + r * F.cos(angle(i))).alias("lon")))


def normalize_mac(x) -> Column:
    """Upper case, trimmed, without a /mask; blank is null."""
    return F.nullif(F.upper(F.trim(F.split_part(F.trim(_c(x)), F.lit("/"), F.lit(1)))), F.lit(""))


def first_of(*xs) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(_c(x), F.lit("")) for x in xs))


def finite(x) -> Column:
    """A finite double, else null."""
    v = _c(x).try_cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def place_id(lat, lon) -> Column:
    """loc_ and twelve hex digits of the rounded point."""
    return F.concat(F.lit("loc_"), F.substring(F.sha1(F.concat_ws(",", F.format_string("%.6f", _c(lat)), F.format_string("%.6f", _c(lon)))), 1, 12))


def pair_id(a, b) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b))), 256), 1, 16)


def contains_any(x, words: list[str]) -> Column:
    low, out = F.lower(_c(x)), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def subject_token(x) -> Column:
    """ssid(len=N,h=XXXX) in place of a name; ? for nothing."""
    c = _c(x)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("?")).otherwise(F.concat(F.lit("ssid(len="), F.length(c).cast("string"), F.lit(",h="), F.substring(F.sha1(c), 1, 4), F.lit(")")))


def mask_macs(x) -> Column:
    return F.regexp_replace(_c(x), MAC, "$1:$2:xx:xx:xx:$3")


def neutral_text(x) -> Column:
    """MACs masked; control, direction and markup characters blanked; runs of blanks closed up."""
    t = F.regexp_replace(mask_macs(x), "[\\x00-\\x1f\\x7f-\\x9f\\u200b-\\u200f\\u202a-\\u202e\\u2028\\u2029\\ufeff]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[<>\[\]`]", " "), r" +", " "))


def replace_subjects(x, subjects: list[str]) -> Column:
    """Known names become tokens, the longest first."""
    out = _c(x)
    for s in sorted(set(filter(None, subjects)), key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(s), subject_token(F.lit(s)))
    return out


def error_text(name, message, most: int = 200) -> Column:
    """A failure's name and message without addresses of devices or paths, shortened."""
    m = F.regexp_replace(F.coalesce(_c(message), F.lit("")), r"\b([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", "<mac>")
    m = F.regexp_replace(F.regexp_replace(m, r"(?:/home|/Users)/[^\s:]+", "<path>"), r"(?:/var|/opt|/tmp|/run)/[^\s:]+", "<path>")
    m = F.trim(F.regexp_replace(m, r"\s+", " "))
    out = F.when(m == "", _c(name)).otherwise(F.concat(_c(name), F.lit(": "), m))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 3), F.lit("..."))).otherwise(out)


def valid_mac(x) -> Column:
    return F.coalesce(_c(x).rlike(r"^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"), F.lit(False))


def valid_ssid(x) -> Column:
    """One to 32 characters, none of them a control (but tab and line ends) or a dangerous one."""
    c = _c(x)
    return F.coalesce(F.length(c).between(1, 32) & ~c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") & (F.translate(c, DANGEROUS, "") == c), F.lit(False))


def valid_path(x) -> Column:
    c = _c(x)
    return F.coalesce((F.length(c) <= 4096) & ~F.contains(c, F.lit("..")) & ~F.contains(c, F.lit("~")) & (F.translate(c, "<>|&;`", "") == c), F.lit(False))


def valid_filename(x) -> Column:
    c = _c(x)
    return F.coalesce((F.length(c) <= 255) & ~F.startswith(c, F.lit(".")) & c.rlike(r"^[a-zA-Z0-9._\-]+$"), F.lit(False))


def valid_json(x, most: int = 1 << 20) -> Column:
    """Whether a text is JSON of a bearable size."""
    return F.coalesce((F.length(_c(x)) <= most) & F.try_parse_json(_c(x)).isNotNull(), F.lit(False))


def sanitize(x, most: int = 1000) -> Column:
    """A text without controls, dangerous characters and words of SQL (in capitals or small letters), cut to `most` characters; null becomes empty."""
    out = F.substring(F.coalesce(_c(x), F.lit("")), 1, most)
    out = F.translate(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), DANGEROUS, "")
    # a fold over the words binds the text at each step, so that the expression does not grow with their number
    without = lambda t, w: F.when(F.contains(F.upper(t), w), F.replace(F.replace(t, w, F.lit("")), F.lower(w), F.lit(""))).otherwise(t)
    return F.trim(F.aggregate(F.array(*(F.lit(w) for w in SQL_WORDS)), out, without))


def escape_cdata(x) -> Column:
    """A text that cannot close a CDATA section: the specials of HTML, quotes too."""
    return F.replace(F.replace(escape_xml(x), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def sealed(x, key) -> Column:
    """enc:v1: and the base64 of nonce and AES-GCM text. Every call gives another text: no key for joins."""
    return F.concat(F.lit("enc:v1:"), F.base64(F.aes_encrypt(_c(x).cast("binary"), _c(key), F.lit("GCM"))))


def opened(x, key) -> Column:
    """What sealed() hid; a text without its mark as it is, null if it cannot be opened."""
    c = _c(x)
    return F.when(F.startswith(c, F.lit("enc:v1:")), F.try_aes_decrypt(F.unbase64(F.substring(c, 8, 1 << 30)), _c(key), F.lit("GCM")).cast("string")).otherwise(c)


def escape_markdown(x) -> Column:
    out = _c(x)
    for ch in MARKDOWN:
        out = F.replace(out, F.lit(ch), F.lit("\\" + ch))
    return out


def escape_xml(x) -> Column:
    out = _c(x)
    for ch, to in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        out = F.replace(out, F.lit(ch), F.lit(to))
    return out


def strength(x) -> Column:
    """The highest level whose name the encryption text contains."""
    up, out = F.upper(_c(x)), F.lit(0)
    for name, level in STRENGTHS.items():
        out = F.greatest(out, F.when(F.contains(up, F.lit(name)), F.lit(level)).otherwise(0))
    return out


def is_downgrade(expected, actual) -> Column:
    return strength(actual) < strength(expected)


def encryption_matches(expected, actual) -> Column:
    e, a = F.upper(_c(expected)), F.upper(_c(actual))
    out = e == a
    for p, q in (("WPA2-PSK", "WPA2"), ("WPA3-SAE", "WPA3"), ("WPA2-CCMP", "WPA2")):
        out = out | (F.contains(e, F.lit(p)) & F.contains(a, F.lit(q))) | (F.contains(e, F.lit(q)) & F.contains(a, F.lit(p)))
    return out


def channel_of(khz) -> Column:
    """Wi-Fi channel of a centre frequency in kHz: 5 MHz steps from 2412 MHz, and the 5 GHz channels at 5000 MHz + 5 x channel; else null."""
    f = _c(khz)
    low = F.when(f.between(2412000, 2472000) & ((f - 2412000) % 5000 == 0), ((f - 2412000) / 5000 + 1).cast("int"))
    ch = ((f - 5000000) / 5000).cast("int")
    on_grid = (f % 5000 == 0) & ((ch.between(36, 64) & (ch % 4 == 0)) | (ch.between(100, 144) & (ch % 4 == 0)) | (ch.between(149, 165) & (ch % 4 == 1)))
    return F.coalesce(low, F.when(on_grid, ch))


def tracker_score(name, blob, is_ble: Column) -> Column:
    """Score of a Bluetooth tracker from its name and metadata text."""
    b = F.lower(_c(blob))
    s = F.lit(0.25) + F.when(_c(name).rlike(TRACKER_NAMES), 0.55).otherwise(0.0)
    s = s + F.when(F.contains(b, F.lit("find my")) | F.contains(b, F.lit("findmy")) | F.contains(b, F.lit("continuity")), 0.35).otherwise(0.0)
    s = s + F.when(F.contains(b, F.lit("airtag")), 0.4).otherwise(0.0)
    return F.when(is_ble, F.least(F.lit(1.0), s)).otherwise(0.0)


def jaccard(a, b) -> Column:
    n = F.size(F.array_union(_c(a), _c(b)))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / n)


def round6(x: Column) -> Column:
    """Six places by the binary value; round() goes by the shortest decimal text and differs on ties."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def fused(support, contra, cap: float = 0.99, exact: bool = False) -> Column:
    """Confidence of evidence: support lines (kind, detail, w) combine as 1 - prod(1 - w), contra lines shrink it; both in the order of kind and detail. Six places unless exact."""
    keep = lambda xs: F.aggregate(F.array_sort(_c(xs)), F.lit(1.0), lambda acc, x: acc * (1 - F.abs(x["w"])))
    c = F.greatest(F.lit(0.0), F.least((1 - keep(support)) * keep(contra), F.lit(cap)))
    return c if exact else round6(c)


def state_of(fail, alert, watch, degraded) -> Column:
    """The ladder fail > alert > watch > degraded > clear."""
    return F.when(_c(fail), "fail").when(_c(alert), "alert").when(_c(watch), "watch").when(_c(degraded), "degraded").otherwise("clear")


def scan_start(watermark, now, catch_up: float = 1800.0, skew: float = 300.0) -> Column:
    """Where an incremental scan begins: the watermark unless it lies in the untrusted future, and never before the catch-up window."""
    back = F.greatest(F.lit(0.0), _c(now) - catch_up)
    return F.greatest(F.when(_c(watermark) > _c(now) + skew, F.lit(0.0)).otherwise(F.coalesce(_c(watermark), F.lit(0.0))), back)


SQL_FUNCTIONS = {
    "sky_haversine": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        f"2 * {EARTH_M}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "sky_mac": ("raw STRING", "STRING", "nullif(upper(trim(split_part(trim(raw), '/', 1))), '')"),
    "sky_token": ("name STRING", "STRING", "CASE WHEN coalesce(name, '') = '' THEN '?' ELSE concat('ssid(len=', length(name), ',h=', substring(sha1(name), 1, 4), ')') END"),
}


def register_sql(spark: SparkSession) -> None:
    """The scalar functions for SQL text, as inlined SQL functions."""
    for name, (args, out, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")
