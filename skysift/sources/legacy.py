"""Whole-capture reads and exports: appearances, GPS points, dated logs, paths, KML and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysift.functions.columns import circle, escape_xml


def appearances(devices: DataFrame, location: Column | None = None) -> DataFrame:
    """devices -> (subject, ts, type, location): every device with a time, the newest first when sorted by ts."""
    return devices.where("last_time > 0").select(F.upper("devmac").alias("subject"), F.col("last_time").alias("ts"), "type", (F.lit(None).cast("string") if location is None else location).alias("location"))


def newest_files(spark: SparkSession, folder: str, pattern: str, now: float, hours: float = 24.0) -> DataFrame:
    """(path, modified) of the captures written in the last hours, from listings alone."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").cast("double").alias("modified"))
    return f.where(F.col("modified") >= now - hours * 3600)


def dated_logs(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """(file, value): lines of logs whose name holds a date of the range (yyyy-mm-dd); other files are not opened beyond their listing."""
    t = spark.read.text(folder, pathGlobFilter="*").select(F.col("_metadata.file_name").alias("file"), "value")
    day = F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1)
    return t.where((day >= first) & (day <= last))


def gps_points(devices: DataFrame) -> DataFrame:
    """Distinct (lat, lon, ts) of devices with a place."""
    return devices.where("avg_lat <> 0 AND avg_lon <> 0 AND first_time IS NOT NULL").select(F.col("avg_lat").alias("lat"), F.col("avg_lon").alias("lon"), F.col("first_time").alias("ts")).distinct()


def with_place(seen: DataFrame, sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Appearances with the place of the session that was running: the last to start before each (carried forward in time order)."""
    s = sessions.select(*keys, F.col("start_ts").alias("ts"), F.col("place").alias("_place"))
    both = seen.withColumn("_place", F.lit(None).cast(s.schema["_place"].dataType)).withColumn("_o", F.lit(1)).unionByName(s.withColumn("_o", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("ts", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("place", F.last("_place", ignorenulls=True).over(w)).where("_o = 1").drop("_place", "_o")


def devices_by_place(seen: DataFrame, place: str) -> DataFrame:
    return seen.groupBy(place).agg(F.array_sort(F.collect_set("subject")).alias("subjects"))


def multi_place(seen: DataFrame, place: str, least: int = 2) -> DataFrame:
    """(subject, places): the places of each subject that was at several."""
    return seen.groupBy("subject").agg(F.array_sort(F.collect_set(place)).alias("places")).where(F.size("places") >= least)


def tracks(sessions: DataFrame, seen: DataFrame, place: str) -> DataFrame:
    """(subject, path): the coordinates of each several-place subject's sessions in time order; sessions (place, start_ts, lat, lon)."""
    at = seen.select("subject", place).distinct()
    several = at.groupBy("subject").agg(F.count("*").alias("n")).where("n > 1").select("subject")
    s = at.join(several, "subject", "left_semi").join(sessions, place)
    point = F.struct("start_ts", "lon", "lat")
    return s.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("path"))


def time_groups(temporal: DataFrame) -> DataFrame:
    """legacy_stats.temporal with the track that a subject is drawn on: work hours, else off hours; regular ones on another beside it."""
    track = F.when(F.col("work_ratio") > 0.7, "work").when(F.col("off_ratio") > 0.7, "off")
    return temporal.select("subject", track.alias("track"), "regular")


def simulated_route(spark: SparkSession, points: int = 12, lat: float = 33.4484, lon: float = -112.074, step: float = 0.001, start: float = 0.0, every: float = 60.0) -> DataFrame:
    """A straight made-up route for trials."""
    i = F.col("id")
    return spark.range(points).select((F.lit(lat) + i * step).alias("lat"), (F.lit(lon) + i * step).alias("lon"), (F.lit(start) + i * every).alias("ts"))


def placemarks(places: DataFrame) -> DataFrame:
    """places (name, lat, lon, radius, note) -> (name, kml): a point and its circle as KML text; names and notes escaped."""
    text = lambda c: F.format_string("%.6f", c)
    ring = F.array_join(F.transform(circle("lat", "lon", "radius"), lambda p: F.concat(text(p["lon"]), F.lit(","), text(p["lat"]), F.lit(",0"))), " ")
    body = F.concat(
        F.lit("<Placemark><name>"), escape_xml("name"), F.lit("</name><description>"), escape_xml(F.coalesce("note", F.lit(""))), F.lit("</description><MultiGeometry><Point><coordinates>"),
        text(F.col("lon")), F.lit(","), text(F.col("lat")), F.lit(",0</coordinates></Point><Polygon><outerBoundaryIs><LinearRing><coordinates>"), ring, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>"),
    )
    return places.select("name", body.alias("kml"))


def write_kml(places: DataFrame, path: str, title: str) -> None:
    """Part files of placemarks between a head and a foot, which sort before and after them: read in order of name they are one document."""
    marks = placemarks(places)
    head = places.sparkSession.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{title}</name>'), (2, "</Document></kml>")], "o int, value string")
    rows = marks.select(F.lit(1).alias("o"), F.col("kml").alias("value")).unionByName(head)
    rows.repartitionByRange(max(3, marks.rdd.getNumPartitions()), "o", "value").sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)


def export_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
