"""What is said of incidents: evidence lines and blocks, the day's counts, report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.columns import escape_markdown, neutral_text

LINE = "struct<kind:string,detail:string,weight:double,obs_ids:array<bigint>>"
EVIDENCE = f"struct<fusion:struct<why:array<{LINE}>,against:array<{LINE}>>,obs_ids:array<bigint>,reasons:array<string>>"


def match_reasons(kind: Column, window: Column, severity: Column, count: Column, place: Column, baselined: Column, suppressed: Column) -> Column:
    """Why a window match was filed, line by line."""
    first = F.when(kind == "mac_reappear", F.concat(F.lit("MAC reappeared in "), window, F.lit(" minute window")))
    first = first.when(kind == "ssid_probe_repeat", F.concat(F.lit("SSID probe repeated in "), window, F.lit(" minute window"))).otherwise(F.concat(F.lit("Event "), kind, F.lit(" in window "), window))
    return F.array_compact(F.array(
        first, F.concat(F.lit("severity="), severity), F.when(count > 1, F.concat(F.lit("observed "), count.cast("string"), F.lit(" times this session open"))),
        F.when(F.coalesce(place, F.lit("")) != "", F.concat(F.lit("place="), place)), F.when(baselined, "entity is on baseline for this place"), F.when(suppressed, "suppressed from threat score (baseline/ignore)"),
    ))


def subject_mark(subject: Column) -> Column:
    """Eight hex digits that stand for a subject in evidence; the same after a restart."""
    n = F.conv(F.substring(F.sha1(subject), 1, 8), 16, 10).cast("long") % 0xFFFFFFFF
    return F.lpad(F.lower(F.hex(n)), 8, "0")


def incident_fields(results: DataFrame) -> DataFrame:
    """results (detector, kind, subject, severity, observed_at, summary, lines) -> the fields of an incident, its evidence as JSON with reasons first."""
    reasons = F.transform("lines", lambda x: x["detail"])
    evidence = F.to_json(F.struct(F.col("kind"), reasons.alias("reasons"), subject_mark(F.col("subject")).alias("subject_fp"), F.col("lines").alias("evidence_lines")))
    return results.select(F.col("kind").alias("event_type"), "subject", "severity", "observed_at", "summary", evidence.alias("evidence_json"))


def evidence_lines(rows: DataFrame) -> DataFrame:
    """incidents (event_type, summary, evidence_json, ...) with why and against: the weighted lines of the stored block, against as negative weights. A row
    without a block has one line, named by its event, that carries the row's own observation ids."""
    e = F.from_json("evidence_json", EVIDENCE)
    why, against = F.coalesce(e["fusion"]["why"], F.array().cast(f"array<{LINE}>")), F.coalesce(e["fusion"]["against"], F.array().cast(f"array<{LINE}>"))
    none = F.array().cast("array<bigint>")
    line = lambda sign: lambda x: F.struct(F.coalesce(x["kind"], F.lit("unknown")).alias("kind"), F.coalesce(x["detail"], F.lit("")).alias("detail"), sign(F.coalesce(x["weight"], F.lit(0.0))).alias("weight"), F.coalesce(x["obs_ids"], none).alias("obs_ids"))
    own = F.array(F.struct(F.col("event_type").alias("kind"), F.col("summary").alias("detail"), F.lit(0.0).alias("weight"), F.coalesce(e["obs_ids"], none).alias("obs_ids")))
    stored = (F.size(why) > 0) | (F.size(against) > 0)
    return rows.withColumns({"why": F.when(stored, F.transform(why, line(lambda w: w))).otherwise(own), "against": F.when(stored, F.transform(against, line(lambda w: -F.abs(w)))).otherwise(F.slice(own, 1, 0))})


def explained(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, detector, kind, detail, w, contra, confidence, kinds, may_alert) -> the text block of each assessment: confidence, why by falling weight,
    against by weight. Details are neutralised, then escaped."""
    text = escape_markdown(neutral_text("detail"))
    signed = F.when(F.col("contra"), -F.abs("w")).otherwise(F.col("w"))
    said = F.concat(escape_markdown("kind"), F.lit(" "), F.when(signed >= 0, "+").otherwise(""), F.format_string("%.2f", signed), F.lit(" — "), text, F.lit(" ("), escape_markdown("detector"), F.lit(")"))
    row = F.struct(F.when(F.col("contra"), signed).otherwise(-signed).alias("o"), "kind", "detail", "detector", said.alias("said"))
    g = lines.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(~F.col("contra"), row))).alias("why"), F.array_sort(F.collect_list(F.when(F.col("contra"), row))).alias("against"),
        F.countDistinct("detector").alias("detectors"), *(F.first(c).alias(c) for c in ("confidence", "kinds", "may_alert")),
    )
    part = lambda title, c, mark: F.concat(F.array(F.lit(title)), F.transform(c, lambda x: F.concat(F.lit(f"  {mark} "), x["said"])))
    none = F.array().cast("array<string>")
    head = F.concat(F.lit("Confidence: "), F.format_string("%.0f%%", F.col("confidence") * 100), F.lit(" ("), F.col("kinds").cast("string"), F.lit(" independent kinds, "), F.col("detectors").cast("string"), F.lit(" detector(s))"))
    body = F.concat(
        F.array(head), F.when(F.size("why") > 0, part("Why:", "why", "+")).otherwise(F.array(F.lit("Why: (no supporting evidence)"))), F.when(F.size("against") > 0, part("Against:", "against", "-")).otherwise(none),
        F.when(~F.col("may_alert"), F.array(F.lit("Not alertable: independent evidence below the required kinds (repetition alone is never sufficient)."))).otherwise(none),
    )
    return g.select(*keys, F.array_join(body, "\n").alias("text"))


def day_counts(incidents: DataFrame, events: DataFrame, links: DataFrame, start: float, end: float) -> DataFrame:
    """One row of the day's counts: incidents opened, reopened and closed, hits of each family last seen in the day, fingerprint links of all time."""
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    e = events.where(inside("ts")).agg(*(F.count_if(F.col("event_type") == f"incident_{x}").alias(x) for x in ("opened", "reopened", "closed")))
    i = incidents.where(inside("last_seen")).agg(F.count_if(F.col("event_type").like("ble_%")).alias("ble_hits"), F.count_if(F.col("event_type").like("deauth%")).alias("deauth_hits"), F.count_if(F.col("event_type").like("rogue%")).alias("rogue_hits"))
    return e.crossJoin(i).crossJoin(links.agg(F.count("*").alias("fingerprint_links")))  # single rows of aggregates


def top_cotravel(cotravel: DataFrame, start: float, end: float, n: int = 10) -> DataFrame:
    """The day's strongest companions."""
    return cotravel.where((F.col("last_seen") >= start) & (F.col("last_seen") < end)).orderBy(F.desc("score"), "subject").limit(n)


def attack_lines(attacks: DataFrame) -> DataFrame:
    """(o, line): a Markdown line for each attack, in the report's order."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
    line = F.concat(F.lit("- **"), F.col("severity"), F.lit("** "), escape_markdown(F.col("target").cast("string")), F.lit(" from "), escape_markdown(F.col("source").cast("string")), F.lit(": "), F.col("n").cast("string"), F.lit(" frames"))
    return attacks.select(F.struct(rank.alias("rank"), "target", "source").alias("o"), line.alias("line"))


def markdown(title: str, lines: DataFrame, most: int = 1000) -> str:
    """A report of at most `most` lines in order; how many more there are is said."""
    total = lines.count()
    shown = [r["line"] for r in lines.orderBy("o").limit(most).collect()]
    rest = [f"- and {total - most} more"] if total > most else []
    return "\n".join([f"# {title}", "", *(shown or ["Nothing found."]), *rest]) + "\n"


def html(text: str) -> str:
    """A report's headings and list lines as HTML; everything else is escaped text."""
    out, inside = [], False
    safe = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    for line in text.split("\n"):
        item = line.startswith("- ")
        if item != inside:
            out.append("<ul>" if item else "</ul>")
            inside = item
        level = len(line) - len(line.lstrip("#"))
        if item:
            out.append(f"<li>{safe(line[2:])}</li>")
        elif 0 < level <= 6 and line[level : level + 1] == " ":
            out.append(f"<h{level}>{safe(line[level + 1 :])}</h{level}>")
        elif line:
            out.append(f"<p>{safe(line)}</p>")
    return "<html><body>\n" + "\n".join(out + ["</ul>"] * inside) + "\n</body></html>\n"


def attach_fusion(fields: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Incident fields with their fused block under `fusion` in the evidence; an incident whose fusion is missing, or whose evidence is no JSON object, ships
    as it is."""
    e = fields.join(blocks.select(*keys, F.to_json("fusion").alias("_f")), keys, "left")
    entries = F.map_filter(F.from_json("evidence_json", "map<string,variant>"), lambda k, _: k != "fusion")
    whole = F.to_json(F.map_concat(entries, F.create_map(F.lit("fusion"), F.try_parse_json("_f"))))
    return e.withColumn("evidence_json", F.when(F.col("_f").isNull(), F.col("evidence_json")).otherwise(F.coalesce(whole, F.col("evidence_json")))).drop("_f")


def status_report(snapshot: DataFrame, inputs: DataFrame, active: DataFrame, now: float, stale: float = 150.0, most: int = 20) -> dict:
    """One glance: the published state, honest about its age, the counts behind it, and at most `most` active phenomena."""
    snap, counts = snapshot.limit(1).collect(), inputs.first().asDict()
    state, reason = ("unknown", "no status published") if not snap else (snap[0]["state"], None)
    if snap and now - float(snap[0]["ts"]) > stale:
        state, reason = "fail", f"status is {now - float(snap[0]['ts']):.0f} s old"
    return {"state": state, "reason": reason, "counts": counts, "active": [r.asDict() for r in active.limit(most).collect()]}
