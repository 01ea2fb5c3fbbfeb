"""Readers: capture tables, scenario documents, ignore lists, probe logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEVICES = "devmac string, type string, device string, last_time double, first_time double, avg_lat double, avg_lon double"
ALERTS = "ts_sec double, header string, json string, src_mac string, dst_mac string, bssid string"
ROW = "struct<source:string,row:string,fix:struct<lat:double,lon:double,ts:double,accuracy_m:double>>"
SCENARIO = (
    "scenario_version int, scenario_id string, session_id string, description string, close_after_seconds double, restarts array<int>, "
    "config_overrides string, faults array<struct<component:string,from_cycle:int,error:string>>, "
    "labels struct<kind:string,expect:struct<detect:boolean,state:string,max_latency_cycles:int,max_incidents:int,entity_keys:array<string>,no_raw_strings:array<string>>>, "
    f"cycles array<struct<cycle_id:int,clock_ts:double,rows:array<{ROW}>>>"
)


def newest(spark: SparkSession, folder: str, pattern: str = "*") -> str | None:
    """The capture written last, from file listings alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


class Resolver:
    """The newest capture of a folder, and whether it is another one than before."""

    def __init__(self, spark: SparkSession, folder: str, pattern: str = "*"):
        self.spark, self.folder, self.pattern, self.current, self.just_rolled = spark, folder, pattern, None, False

    def resolve(self) -> str:
        found = newest(self.spark, self.folder, self.pattern)
        if found is None:
            self.just_rolled = False
            raise FileNotFoundError(f"{self.folder}/{self.pattern}")
        self.just_rolled, self.current = found != self.current, found
        return found


def missing_columns(table: DataFrame, schema: str = DEVICES) -> list[str]:
    """Columns of a capture table that a file lacks or holds in another type; an empty list validates it. Only the schema is read."""
    want = {f.name: f.dataType for f in table.sparkSession.createDataFrame([], schema).schema}
    have = {f.name: f.dataType for f in table.schema}
    return [c for c, t in want.items() if have.get(c) != t]


def macs_between(devices: DataFrame, start: float, end: float | None = None) -> DataFrame:
    """Only the addresses of a time range; no other column but the time is read."""
    return devices_between(devices.select("devmac", "last_time"), start, end).where("devmac is not null").select("devmac")


def devices_between(devices: DataFrame, start: float, end: float | None = None) -> DataFrame:
    """Closed at both ends; the range reaches the scan as a pushed filter."""
    d = devices.where(F.col("last_time") >= start)
    return d if end is None else d.where(F.col("last_time") <= end)


def probes_between(devices: DataFrame, start: float, end: float | None = None) -> DataFrame:
    """(mac, ssid, ts) of the network each device probed last; blank names go."""
    path = '$["dot11.device"]["dot11.device.last_probed_ssid_record"]["dot11.probedssid.ssid"]'
    d = devices_between(devices, start, end).select(F.col("devmac").alias("mac"), F.try_variant_get(F.try_parse_json("device"), path, "string").alias("ssid"), F.col("last_time").alias("ts"))
    return d.where("ssid is not null and ssid <> ''")


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario documents as rows (scenario_id, session_id, cycle_id, clock_ts, source, row, fix); JSON rows stay text."""
    docs = spark.read.schema(SCENARIO).option("multiLine", True).json(path)
    c = docs.select("scenario_id", "session_id", F.explode("cycles").alias("c"))
    return c.select("scenario_id", "session_id", "c.cycle_id", "c.clock_ts", F.explode_outer("c.rows").alias("r")).select("scenario_id", "session_id", "cycle_id", "clock_ts", "r.source", "r.row", "r.fix")


#: Keys that a scenario document may have.
SCENARIO_KEYS = ["scenario_version", "scenario_id", "session_id", "description", "close_after_seconds", "restarts", "config_overrides", "faults", "labels", "cycles"]


def unknown_keys(spark: SparkSession, path: str) -> DataFrame:
    """(file, key) of top-level keys that no scenario has: a misspelt one must not pass as absent."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.explode(F.json_object_keys("value")).alias("key"))
    return t.where(~F.col("key").isin(SCENARIO_KEYS))


def status_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The published status; a table without rows where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "state string, ts double")
    return spark.read.json(path)


def scenario_problems(spark: SparkSession, path: str) -> DataFrame:
    """(scenario_id, problem) of documents that break the format."""
    d = spark.read.schema(SCENARIO).option("multiLine", True).json(path)
    bad = F.array_compact(F.array(
        F.when(F.coalesce(F.col("scenario_version"), F.lit(0)) != 1, "version"), F.when(F.coalesce(F.col("scenario_id"), F.lit("")) == "", "scenario_id"),
        F.when(~F.coalesce(F.col("labels.kind").isin("normal", "suspicious", "edge"), F.lit(False)), "labels.kind"), F.when(F.coalesce(F.size("cycles"), F.lit(0)) <= 0, "cycles"),
        F.when(F.exists("cycles", lambda c: c["clock_ts"].isNull()), "clock_ts"), F.when(F.col("labels.expect.detect") & (F.col("labels.expect.state") == "clear"), "detect without state"),
    ))
    return d.select("scenario_id", F.explode(bad).alias("problem"))


#: A string of a Python-style list, in either quotes, with its escapes.
_LITERAL = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """(subject) from a JSON array or a Python-style list, assigned to a name or not, in a text file; comments and a last comma may stand in the latter.

    An empty file names nothing; one that is neither raises: an ignore list that is silently empty would alert on all that it names."""
    t = spark.read.text(path, wholetext=True).withColumn("body", F.regexp_extract("value", r"(?s)(\[.*\])", 1))
    bare = F.regexp_replace("body", rf"({_LITERAL})|#[^\n]*", "$1")
    literals = F.regexp_extract_all(bare, F.lit(f"({_LITERAL})"), 1)
    plain = F.transform(literals, lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    rest = F.regexp_replace(F.regexp_replace(bare, _LITERAL, "s"), r"\s", "")
    listed = F.when(rest.rlike(r"^\[(s(,s)*,?)?\]$"), plain).otherwise(F.raise_error(F.concat(F.lit("no list of names: "), F.input_file_name())))
    names = t.select(F.explode(F.coalesce(F.from_json("body", "array<string>", {"allowSingleQuotes": "false"}), listed)).alias("subject"))
    return names.select(F.upper(F.trim("subject")).alias("subject")).where("subject <> ''").distinct()


def probe_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, stamp, ssid) of probe lines; a line takes the nearest stamp before it in its file. A log may be read in any number of pieces: lines are
    numbered, from 0, by where their piece begins in the file and by their place in it."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"), "value")
    t = t.withColumns({"own": F.nullif(F.regexp_extract("value", r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit("")), "ssid": F.nullif(F.regexp_extract("value", r"[Pp]rob\w*[^:]*: ?(\S.*)$", 1), F.lit(""))})
    w = Window.partitionBy("file").orderBy("at", "place")
    t = t.withColumns({"stamp": F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "line": (F.row_number().over(w) - 1).cast("long")})
    return t.where("ssid is not null").select("file", "line", "stamp", "ssid")
