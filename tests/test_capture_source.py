"""Capture files as tables and as a stream: ranges, pieces, watermarks, crashes."""

import contextlib
import json
import sqlite3

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from skysift.operators import normalize
from skysift.sources import capture_source

T0 = 1700000000.0


def put(path, rows=(), alerts=()):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE IF NOT EXISTS devices (first_time INT, last_time INT, devkey TEXT, devmac TEXT, type TEXT, device BLOB)")
    db.execute("CREATE TABLE IF NOT EXISTS alerts (ts_sec INT, header TEXT, json BLOB)")
    db.executemany("INSERT INTO devices (devmac, last_time, type, device) VALUES (?, ?, 'Wi-Fi', ?)", [(m, t, json.dumps({"kismet.device.base.channel": "6"}).encode()) for m, t in rows])
    db.executemany("INSERT INTO alerts VALUES (?, 'DEAUTH', '{}')", [(t,) for t in alerts])
    db.commit()
    db.close()


def test_tables_and_ranges(spark, tmp_path):
    capture_source.register(spark)
    put(tmp_path / "a.kismet", [(f"m{i}", T0 + i) for i in range(250)], [T0, T0 + 1])
    put(tmp_path / "b.kismet", [("n", T0 + 1000), (None, None)])
    (tmp_path / "notes.txt").write_text("no capture")
    read = lambda **o: spark.read.format("capture").options(path=str(tmp_path), pattern="*.kismet", **o).load()
    d = read(rowsPerPartition="100")
    assert d.dtypes == [("devmac", "string"), ("type", "string"), ("device", "string"), ("last_time", "double"), ("first_time", "double"), ("avg_lat", "double"), ("avg_lon", "double")]
    assert d.rdd.getNumPartitions() == 4 and d.count() == 251, "rows without a time are in no range"
    r = d.where("devmac = 'm7'").first()
    assert (r.last_time, r.avg_lat, json.loads(r.device)) == (T0 + 7, None, {"kismet.device.base.channel": "6"})
    assert sorted(r.devmac for r in read(start=str(T0 + 3), end=str(T0 + 5)).collect()) == ["m3", "m4", "m5"], "closed at both ends"
    assert [r.ts_sec for r in read(table="alerts").orderBy("ts_sec").collect()] == [T0, T0 + 1]


def test_watermark_of_a_growing_capture(spark, tmp_path):
    """Cycles over a capture that grows, rolls over, holds rows from the future and from long ago, cannot be read, and a cycle that dies after it wrote."""
    captures, clock, log, checkpoint = tmp_path / "captures", tmp_path / "clock", str(tmp_path / "log"), str(tmp_path / "checkpoint")
    captures.mkdir()
    died: list = []

    def run(now, fail=False):
        clock.write_text(str(now))
        stream = capture_source.capture_stream(spark, str(captures), checkpoint, clockFile=str(clock), rowsPerPartition="2")

        def norm(batch):
            if fail:
                normalize.devices(batch, "s", now).where("reject is null").write.mode("overwrite").parquet(f"{log}/rows/cycle=99")
                died.append(now)
                raise RuntimeError("lost power")
            return normalize.devices(batch, "s", now)

        q = capture_source.ingest_stream(stream, norm, log, checkpoint, None)
        q.awaitTermination(120)

    def marks():
        return {n: o["ts"] for n, o in capture_source.offsets(spark, checkpoint).items()}

    def seen():
        return sorted((r.cycle, r.identity_key) for r in spark.read.parquet(f"{log}/rows").where("cycle < 99").collect())

    put(captures / "a", [("AA:00", T0 - 5000), ("AA:01", T0 - 1000), ("AA:02", T0 - 3), ("", T0 - 2), ("AA:03", T0 + 9000)])
    run(T0)
    first = [(0, "AA:01"), (0, "AA:02")]
    assert seen() == first and marks() == {0: T0 - 1}, "too old, rejected and future rows"
    assert spark.read.json(f"{log}/rejects").count() == 1
    run(T0 + 60)
    assert seen() == first, "nothing new is no cycle"
    put(captures / "a", [("AA:04", T0 + 70), ("AA:05", T0 + 71), ("AA:06", T0 + 72)])
    with pytest.raises(Exception, match="lost power"):
        run(T0 + 120, fail=True)
    assert seen() == first and died
    put(captures / "b", [("BB:01", T0 + 100)])
    run(T0 + 130)
    second = first + [(1, f"AA:0{i}") for i in (4, 5, 6)]
    assert seen()[:5] == second, "the cycle that died comes again with its rows, once"
    assert seen()[5:] in ([], [(2, "BB:01")])
    run(T0 + 140)
    assert seen() == second + [(2, "BB:01")]
    good = (captures / "b").read_bytes()
    (captures / "b").write_bytes(b"no database " * 100)
    with contextlib.suppress(StreamingQueryException):  # a running query would wait; one that starts here fails
        run(T0 + 150)
    assert max(marks().values()) == T0 + 101, "a scan that fails moves nothing"
    (captures / "b").write_bytes(good)
    (captures / "a").unlink()
    (captures / "b").unlink()
    put(captures / "c", [("CC:00", T0 + 50)])
    run(T0 + 160)
    assert seen() == second + [(2, "BB:01")], "a new capture with older rows only does not move the watermark back"
    put(captures / "c", [("CC:01", T0 + 170), ("CC:02", T0 + 9000 - 100)])
    run(T0 + 9000)
    assert [k for _, k in seen()][6:] == ["CC:02"], "after a long pause the catch-up is bounded"
    assert spark.read.parquet(f"{log}/rows").where("cycle < 99").select(F.countDistinct("identity_key")).first()[0] == len(seen())
