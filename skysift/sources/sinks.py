"""Writers: append-only log with rejects, status, debrief, scenario export, ignore lists."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.operators.normalize import split_rejects


def append_observations(normalized: DataFrame, log: str, rejects: str) -> None:
    """Appends good rows, dated for pruning, and keeps the rejected ones with their reason."""
    good, bad = split_rejects(normalized)
    good.withColumn("day", F.date_from_unix_date(F.floor(F.col("ts") / 86400).cast("int"))).write.mode("append").partitionBy("day").parquet(log)
    bad.write.mode("append").json(rejects)


def _replace(lines: DataFrame, path: str) -> None:
    """One file of the only column of a small table, put in the place of the old one by a single rename that overwrites: a reader finds the old or the new. What
    cannot be put in place stays aside under .parked, and the error is the caller's."""
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    aside, target = (hadoop.Path(x) for x in (f"{path.rstrip('/')}.{uuid.uuid4().hex}", path.rstrip("/")))
    lines.coalesce(1).write.text(aside.toString())
    fs = target.getFileSystem(conf)
    new = next(f.getPath() for f in fs.globStatus(hadoop.Path(aside, "part-*")))

    def put(name: str) -> None:
        there = fs.makeQualified(hadoop.Path(name))
        if fs.getScheme() == "file":  # where the other call deletes first
            os.replace(new.toUri().getPath(), there.toUri().getPath())
            return
        how = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(new, there, how)

    try:
        put(path.rstrip("/"))
    except Exception:
        put(f"{path.rstrip('/')}.parked")
        raise
    finally:
        fs.delete(aside, True)


def publish_status(status: DataFrame, path: str) -> None:
    """One row as a JSON file, replaced as a whole: at every moment a reader finds the old status or the new one, and what cannot be published is parked."""
    _replace(status.select(F.to_json(F.struct("*")).alias("value")), path)


def append_status(status: DataFrame, history: str, now: float) -> None:
    """A row of the status history."""
    status.withColumn("ts", F.lit(now)).coalesce(1).write.mode("append").parquet(history)


def append_heartbeat(spark: SparkSession, heartbeats: str, component: str, now: float, ok: bool, detail: str = "") -> None:
    spark.createDataFrame([(component, now, ok, detail)], "component string, ts double, ok boolean, detail string").coalesce(1).write.mode("append").parquet(heartbeats)


def publish_failure(spark: SparkSession, path: str, now: float, reason: str) -> None:
    """A status of fail, for a publisher that cannot compose one; the next publish_status recovers it."""
    publish_status(spark.createDataFrame([("fail", reason, now)], "state string, reason string, ts double"), path)


def save_ignore_list(subjects: DataFrame, path: str) -> None:
    """The list as one JSON array in a file of its own, sorted, replaced as a whole; lists are configuration of bounded size."""
    _replace(subjects.agg(F.to_json(F.array_sort(F.collect_set("subject"))).alias("value")), path)


def debrief_markdown(day: str, transitions: DataFrame, top: DataFrame, multi: DataFrame) -> str:
    """The day's report of bounded tables (a row of counts, twenty incidents, fifteen subjects)."""
    t = transitions.first()
    out = [f"# Debrief {day}", "", f"Opened {t['opened']}, closed {t['closed']}, in sight {t['overlapping']}.", "", "## Incidents", ""]
    out += [f"- {r['severity']}: {r['incident_key']} ({r['n']})" for r in top.limit(20).collect()]
    out += ["", "## Seen at several places", ""]
    out += [f"- {r['subject']}: {r['locations']} places, {r['sees']} sightings" for r in multi.limit(15).collect()]
    return "\n".join(out) + "\n"


def scenario_rows(observations: DataFrame, cycle_s: float) -> DataFrame:
    """observations (ts, ...) -> the same rows with cycle_id and clock_ts, their cycle's latest time. A cycle stays spread over rows."""
    o = observations.withColumn("cycle_id", F.floor(F.col("ts") / cycle_s).cast("long"))
    return o.join(o.groupBy("cycle_id").agg(F.max("ts").alias("clock_ts")), "cycle_id")


def export_scenario(observations: DataFrame, path: str, cycle_s: float) -> None:
    """Observations as JSON rows, a folder for each cycle (cycle_id=...), sorted by time within a file. No cycle has to fit a task."""
    row = F.to_json(F.struct("identity_key", "kind", "lat", "lon", "payload_json")).alias("row")
    c = scenario_rows(observations, cycle_s).select("cycle_id", "clock_ts", "ts", "source", row)
    c.sortWithinPartitions("cycle_id", "ts", "row").write.mode("overwrite").partitionBy("cycle_id").json(path)


#: Rows of a report that comes to the driver; more are refused.
MOST_REPORT = 100_000


def report_bytes(report: DataFrame, order: list[str]) -> bytes:
    """Canonical bytes of a report of at most MOST_REPORT rows: equal reports are equal byte for byte."""
    rows = [r.asDict(recursive=True) for r in report.orderBy(*order).limit(MOST_REPORT + 1).collect()]
    if len(rows) > MOST_REPORT:
        raise ValueError(f"a report has at most {MOST_REPORT} rows")
    return json.dumps(rows, sort_keys=True, separators=(",", ":"), default=str).encode()


def generate_ignore_list(devices: DataFrame) -> DataFrame:
    return devices.select(F.upper(F.trim("devmac")).alias("subject")).where("subject is not null and subject <> ''").distinct()
