"""Capture files (SQLite databases that a sniffer appends to) as a data source: in partitions, by time range, and as a stream with a watermark for its offset."""

from __future__ import annotations

import glob
import json
import math
import os
import sqlite3
import time
from collections.abc import Callable, Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from skysift.operators.normalize import split_rejects
from skysift.sources.captures import ALERTS, DEVICES
from skysift.sources.ingest import CATCH_UP_S, SKEW_S

#: The tables of a capture that can be read, their columns, and the one that holds the time.
TABLES = {"devices": (DEVICES, "last_time"), "alerts": (ALERTS, "ts_sec")}
#: Rows of a partition, by row number, and of a batch within it.
ROWS, BATCH = 100_000, 5_000


class Span(InputPartition):
    """Rows of one file, by row number, whose time lies in [start, end)."""

    def __init__(self, path: str, first: int, last: int, start: float, end: float):
        self.path, self.first, self.last, self.start, self.end = path, first, last, start, end


class _Captures:
    """The files behind the options: path (a file, or a folder of captures that roll over), pattern, table, rowsPerPartition."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.pattern, self.schema = options["path"].removeprefix("file://"), options.get("pattern", "*"), schema
        self.table = options.get("table", "devices")
        self.time = TABLES[self.table][1]
        self.rows = int(options.get("rowsPerPartition", ROWS))

    def files(self) -> list[str]:
        if not os.path.isdir(self.path):
            return [self.path]
        return sorted(f for f in glob.glob(os.path.join(glob.escape(self.path), self.pattern)) if os.path.isfile(f))

    def ask(self, path: str, sql: str, values: tuple) -> list[tuple]:
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=10)) as db:
            return db.execute(sql, values).fetchall()

    def spans(self, start: float, end: float) -> list[Span]:
        """Every file's rows of a time range, in pieces of about as many row numbers each."""
        out = []
        for path in self.files():
            low, high = self.ask(path, f"SELECT min(rowid), max(rowid) FROM {self.table} WHERE {self.time} >= ? AND {self.time} < ?", (start, end))[0]
            if low is not None:
                out += [Span(path, k, min(k + self.rows - 1, high), start, end) for k in range(low, high + 1, self.rows)]
        return out

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        """A column that a file lacks is null there."""
        with closing(sqlite3.connect(f"file:{span.path}?mode=ro", uri=True, timeout=10)) as db:
            have = {row[1] for row in db.execute(f"PRAGMA table_info({self.table})")}
            kinds = {"string": "TEXT", "double": "REAL"}
            columns = ", ".join(f"CAST({f.name} AS {kinds[f.dataType.simpleString()]})" if f.name in have else "NULL" for f in self.schema)
            found = db.execute(f"SELECT {columns} FROM {self.table} WHERE rowid BETWEEN ? AND ? AND {self.time} >= ? AND {self.time} < ? ORDER BY rowid", (span.first, span.last, span.start, span.end))
            schema = pa.schema([(f.name, pa.string() if f.dataType.simpleString() == "string" else pa.float64()) for f in self.schema])
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class CaptureReader(DataSourceReader):
    """All rows, or those of a time range that is closed at both ends (options start and end)."""

    def __init__(self, captures: _Captures, options: dict[str, str]):
        self.captures, self.start, self.end = captures, float(options.get("start", "-inf")), float(options.get("end", "inf"))

    def partitions(self) -> list[Span]:
        return self.captures.spans(self.start, math.nextafter(self.end, math.inf))

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.captures.read(partition)


class CaptureStream(DataSourceStreamReader):
    """An offset is a watermark, one second past the newest time read, and the clock at which it was taken. It never falls below the offset in the option since.

    A batch reads from one watermark up to the next, but no further back than the catch-up from its clock. Times further ahead of the clock than the skew
    move no watermark; rows that stand there are read once the clock has come near. A capture that cannot be read moves nothing either, so that the next
    batch scans again from where the last clean one ended."""

    def __init__(self, captures: _Captures, options: dict[str, str]):
        self.captures = captures
        self.catch_up, self.skew = float(options.get("catchUp", CATCH_UP_S)), float(options.get("skew", SKEW_S))
        self.clock = options.get("clockFile")
        self.known = json.loads(options["since"]) if "since" in options else {"ts": 0.0, "clock": self.now()}

    def now(self) -> float:
        """The host's clock, or the one in a file: for replays."""
        if self.clock:
            with open(self.clock) as f:
                return float(f.read())
        return time.time()

    def initialOffset(self) -> dict:
        now = self.now()
        return {"ts": max(0.0, now - self.catch_up), "clock": now}

    def latestOffset(self) -> dict:
        now = self.now()
        try:
            newest = [self.captures.ask(f, f"SELECT max({self.captures.time}) FROM {self.captures.table} WHERE {self.captures.time} <= ?", (now + self.skew,))[0][0] for f in self.captures.files()]
        except (sqlite3.Error, OSError):
            return self.known
        seen = [t for t in newest if t is not None]
        if seen and max(seen) + 1 > self.known["ts"]:
            self.known = {"ts": max(seen) + 1, "clock": now}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.captures.spans(max(start["ts"], end["clock"] - self.catch_up), end["ts"])

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.captures.read(partition)


class CaptureSource(DataSource):
    """spark.read.format("capture") and spark.readStream.format("capture"): options path, table (devices or alerts), pattern, rowsPerPartition; start and end to
    read; catchUp, skew, since and clockFile to stream. The files have to be reachable under one path by the driver and by all executors."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "devices")][0]

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(_Captures(self.options, schema), self.options)

    def streamReader(self, schema: StructType) -> CaptureStream:
        return CaptureStream(_Captures(self.options, schema), self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def offsets(spark: SparkSession, checkpoint: str) -> dict[int, dict]:
    """Batch number and offset of what a checkpoint's log still holds (Spark keeps the last hundred or so), confirmed or not."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return {}
    rows = spark.read.text(f"{checkpoint}/offsets", wholetext=True).selectExpr("cast(regexp_extract(_metadata.file_name, '^[0-9]+$', 0) as bigint) AS n", "value").where("n is not null")
    return {r.n: json.loads(r.value.strip().splitlines()[-1]) for r in rows.collect()}


def capture_stream(spark: SparkSession, path: str, checkpoint: str, table: str = "devices", **options: str) -> DataFrame:
    """A capture's table as a stream that goes on where its checkpoint stands, even if the capture that led there is gone by now."""
    register(spark)
    done = offsets(spark, checkpoint)
    since = {"since": json.dumps(done[max(done)])} if done else {}
    return spark.readStream.format("capture").options(path=path, table=table, **since, **options).load()


def ingest_stream(stream: DataFrame, normalize: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
    """Starts the ingest of a capture stream: each batch's rows, normalized, go to a folder of the batch's number, rejected ones to another.

    The watermark is the stream's offset. It is set down in the checkpoint before the rows are read and confirmed after they are written; a batch that was
    interrupted in between comes again under its number and replaces what it had written, so that rows and watermark agree after any crash."""

    def cycle(batch: DataFrame, number: int) -> None:
        good, bad = split_rejects(normalize(batch))
        good.write.mode("overwrite").parquet(f"{log}/rows/cycle={number}")
        bad.write.mode("overwrite").json(f"{log}/rejects/cycle={number}")

    w = stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
