"""Incremental ingest: scans behind a watermark, one commit for a cycle's rows and its watermark."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.columns import finite
from skysift.operators.normalize import COLUMNS, split_rejects

CATCH_UP_S, SKEW_S = 1800.0, 300.0


def parse_watermark(raw: Column) -> Column:
    """A stored watermark; null where it is absent, no number, or not positive."""
    v = finite(raw)
    return F.when(v > 0, v)


def start_of_scan(watermark: float | None, now: float, catch_up: float = CATCH_UP_S, skew: float = SKEW_S) -> float:
    """Where a scan begins; the plain twin of columns.scan_start."""
    trusted = watermark if watermark is not None and watermark <= now + skew else 0.0
    return max(trusted, 0.0, now - catch_up)


def scan(rows: DataFrame, ts: str, start: float, now: float) -> DataFrame:
    """Rows from the start up to the cycle's clock; the range reaches the scan as pushed filters."""
    return rows.where((F.col(ts) >= start) & (F.col(ts) <= now))


def cycles(rows: DataFrame, ts: str, clocks: list[float], catch_up: float = CATCH_UP_S) -> DataFrame:
    """(cycle, start, watermark, n) of a run of cycles over a table: each reads behind the watermark that the one before left. One small aggregate a cycle."""
    spark, out, watermark = rows.sparkSession, [], None
    for k, now in enumerate(clocks):
        start = start_of_scan(watermark, now, catch_up)
        n, last = scan(rows, ts, start, now).agg(F.count("*"), F.max(ts)).first()
        watermark = watermark if last is None else last + 1
        out.append((k, start, watermark, n))
    return spark.createDataFrame(out, "cycle int, start double, watermark double, n long")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commits(spark: SparkSession, log: str) -> list[dict]:
    """The log's commits, oldest first. A few bytes for each cycle that is kept."""
    fs, where = _fs(spark, f"{log}/_commits")
    if not fs.exists(where):
        return []
    rows = spark.read.text(f"{log}/_commits/*.json", wholetext=True).collect()
    return sorted((json.loads(r[0]) for r in rows), key=lambda c: c["cycle"])


def ingest(spark: SparkSession, log: str, normalized: dict[str, tuple[DataFrame, str]], now: float) -> dict:
    """One cycle: normalized maps a source to (its normalized rows with reject, their time column). Rows that lie behind the source's watermark and not
    after `now` are written under the cycle's folder, rejects aside; then one commit file is renamed into place that names the folder and the new
    watermarks: the highest time READ plus one, rejected rows included. Rows of a cycle that did not commit are never read, and the next cycle reads
    them again."""
    done = commits(spark, log)
    marks = dict(done[-1]["watermarks"]) if done else {}
    cycle, folder = len(done), f"{log}/rows/{uuid.uuid4().hex}"
    n = 0
    for source, (rows, ts) in normalized.items():
        part = scan(rows, ts, start_of_scan(marks.get(source), now), now)
        good, bad = split_rejects(part)
        good.write.mode("append").parquet(folder)
        bad.write.mode("append").json(f"{log}/rejects")
        read, last = part.agg(F.count("*"), F.max(ts)).first()
        n += read
        if last is not None:
            marks[source] = last + 1
    commit = {"cycle": cycle, "clock": now, "folder": folder, "watermarks": marks, "read": n}
    fs, aside = _fs(spark, f"{log}/_commits/.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps(commit, sort_keys=True).encode()))
    stream.close()
    if not fs.rename(aside, spark._jvm.org.apache.hadoop.fs.Path(f"{log}/_commits/{cycle:09d}.json")):
        raise OSError(f"cycle {cycle} was committed by another writer")
    return commit


def committed(spark: SparkSession, log: str) -> DataFrame | None:
    """All observations of committed cycles; None before the first one."""
    folders = [c["folder"] for c in commits(spark, log)]
    return spark.read.parquet(*folders).select(*COLUMNS) if folders else None
