"""Places and paths: leader clusters, visits, feasible travel, co-travel, density, geofences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysift.functions.columns import EARTH_M, haversine, place_id

MERGE_M, REVISIT_S, SPEED_MPS = 30.0, 600.0, 35.0
#: Height of the grid cells that stand in for distance in joins, in degrees (111 m).
CELL_DEG = 0.001


def metres(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))


def _leaders(radius: float):
    """Streams rows sorted by subject and time; only the current subject's leaders are held, in arrays that grow by doubling."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, n, lats, lons = object(), 0, np.empty(16), np.empty(16)
        for f in frames:
            out, la, lo = [], [], []
            for s, lat, lon in zip(f["subject"].tolist(), f["lat"].tolist(), f["lon"].tolist()):
                if s != subject:
                    subject, n = s, 0
                near = np.flatnonzero(metres(lats[:n], lons[:n], lat, lon) <= radius) if n else ()
                if len(near):
                    at = int(near[0])
                else:
                    if n == len(lats):
                        lats, lons = np.resize(lats, 2 * n), np.resize(lons, 2 * n)
                    at, lats[n], lons[n] = n, lat, lon
                    n += 1
                out.append(at)
                la.append(float(lats[at]))
                lo.append(float(lons[at]))
            yield f.assign(cluster=np.array(out, "int32"), lead_lat=la, lead_lon=lo)

    return run


def assign_clusters(sightings: DataFrame, radius: float = MERGE_M) -> DataFrame:
    """sightings (subject, ts, lat, lon, ...) -> the same and cluster, lead_lat, lead_lon: in order of (ts, lat, lon) a sighting joins its subject's
    first cluster whose leader is within the radius, or leads a new one. Sequential by definition: one ordered pass per subject, state per leader."""
    s = sightings.select("subject", "ts", "lat", "lon", *[c for c in sightings.columns if c not in ("subject", "ts", "lat", "lon")])
    s = s.where("lat is not null and lon is not null").repartition("subject").sortWithinPartitions("subject", "ts", "lat", "lon")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema)
    return s.mapInPandas(_leaders(radius), f"{schema}, cluster int, lead_lat double, lead_lon double")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("subject", "cluster").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.first("lead_lat").alias("lat"), F.first("lead_lon").alias("lon"))


def visits(clustered: DataFrame, gap: float = REVISIT_S) -> DataFrame:
    """(subject, visit, cluster, enter_ts, exit_ts, lat, lon, n): runs in one cluster without a gap; a subject's last visit stays open (null exit)."""
    w = Window.partitionBy("subject").orderBy("ts", "lat", "lon")
    d = clustered.withColumns({"_c": F.lag("cluster").over(w), "_t": F.lag("ts").over(w)})
    new = F.when(F.col("_c").isNull() | (F.col("_c") != F.col("cluster")) | (F.col("ts") - F.col("_t") > gap), 1).otherwise(0)
    d = d.withColumn("_new", new).withColumn("visit", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = d.groupBy("subject", "visit").agg(F.first("cluster").alias("cluster"), F.min("ts").alias("enter_ts"), F.max("ts").alias("end_ts"), F.first("lead_lat").alias("lat"), F.first("lead_lon").alias("lon"), F.count("*").alias("n"))
    last = F.max("visit").over(Window.partitionBy("subject"))
    return v.withColumn("exit_ts", F.when(F.col("visit") < last, F.col("end_ts"))).drop("end_ts")


def _kept(speed: float, accuracy: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, prev = object(), None
        for f in frames:
            keep = []
            for s, enter, exit_, lat, lon in zip(f["subject"].tolist(), f["enter_ts"].tolist(), f["exit_ts"].tolist(), f["lat"].tolist(), f["lon"].tolist()):
                if s != subject:
                    subject, prev = s, None
                ok = prev is None or metres(prev[1], prev[2], lat, lon) <= speed * max(enter - prev[0], 0.0) + 2 * accuracy
                if ok:
                    prev = (enter if exit_ is None or math.isnan(exit_) else exit_, lat, lon)
                keep.append(bool(ok))
            yield f[np.array(keep, bool)]

    return run


def feasible_visits(v: DataFrame, speed: float = SPEED_MPS, accuracy: float = 0.0) -> DataFrame:
    """Visits that can be reached from the last one kept at the given speed."""
    s = v.repartition("subject").sortWithinPartitions("subject", "enter_ts", "visit")
    return s.mapInPandas(_kept(speed, accuracy), s.schema)


def _across(y: F.Column) -> F.Column:
    """How many cells lie around the earth in band y, so that they are about as wide as high at every latitude."""
    edge = F.least(F.abs(y * CELL_DEG), F.abs((y + 1) * CELL_DEG), F.lit(90.0))
    return F.greatest(F.lit(1), F.floor(360 / CELL_DEG * F.cos(F.radians(edge)))).cast("long")


def cell(lat: str, lon: str) -> F.Column:
    """The grid cell (y, x) of a point; bands of latitude, cells around them, the antimeridian no seam."""
    y = F.floor(F.col(lat) / CELL_DEG)
    n = _across(y)
    return F.struct(y.alias("y"), F.pmod(F.floor((F.col(lon) + 180) / 360 * n), n).alias("x"))


def cells_near(lat: str, lon: str, radius: float) -> F.Column:
    """All cells that a point within `radius` metres may lie in; near a pole whole bands."""
    high = float(np.degrees(radius / EARTH_M)) * 1.001
    top = F.abs(F.col(lat)) + high
    reach = F.when(top >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(float(np.radians(high)))) / F.cos(F.radians(F.col(lat)))))))

    def band(y: F.Column) -> F.Column:
        n = _across(y)
        lo, hi = (F.floor((F.col(lon) + side * reach + 180) / 360 * n) for side in (-1, 1))
        xs = F.when(hi - lo + 1 >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(lo, hi), lambda x: F.pmod(x, n)))
        return F.transform(xs, lambda x: F.struct(y.alias("y"), x.alias("x")))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.floor((F.col(lat) - high) / CELL_DEG), F.floor((F.col(lat) + high) / CELL_DEG)), band)))


def _slots(start: F.Column, end: F.Column, width: float) -> F.Column:
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))


def cotravel(entity: DataFrame, operator: DataFrame, radius: float = MERGE_M, gap: float = REVISIT_S, lateness: str | None = None) -> DataFrame:
    """Entity visits that meet an operator visit in place (2 x radius) and time. Both sides take an equi-key of grid cell and time slot; a pair that shares
    several slots is kept in the first of them. Partitions crowded by one cell are Spark's to split; neither side is broadcast unless small.

    With `lateness` both sides may be streams: the slot's time is the event time, and a slot that the watermark has passed is dropped from the join's state. A
    visit is known once it is over, so lateness has to be no less than the longest visit."""
    width = max(gap, 3600.0)
    o = operator.select(F.col("visit").alias("op_visit"), F.col("cluster").alias("op_cluster"), F.col("enter_ts").alias("op_enter"), F.coalesce("exit_ts", F.col("enter_ts") + gap).alias("op_end"), F.col("lat").alias("op_lat"), F.col("lon").alias("op_lon"))
    o = o.withColumn("_cell", F.explode(cells_near("op_lat", "op_lon", 2 * radius))).withColumn("_slot", F.explode(_slots(F.col("op_enter"), F.col("op_end"), width)))
    e = entity.withColumn("_end", F.coalesce("exit_ts", F.col("enter_ts") + gap)).withColumn("_cell", cell("lat", "lon"))
    e = e.withColumn("_slot", F.explode(_slots(F.col("enter_ts"), F.col("_end"), width)))
    if lateness is not None:
        e, o = (d.withColumn("_slot", F.timestamp_seconds(F.col("_slot") * width)).withWatermark("_slot", lateness) for d in (e, o))
    met = e.join(o, ["_cell", "_slot"]).where((F.col("enter_ts") <= F.col("op_end")) & (F.col("op_enter") <= F.col("_end")))
    first = F.floor(F.greatest("enter_ts", "op_enter") / width)
    met = met.where(F.col("_slot") == (first if lateness is None else F.timestamp_seconds(first * width)))
    return met.where(haversine("lat", "lon", "op_lat", "op_lon") <= 2 * radius).drop("_cell", "_slot", "_end")


def cotravel_scores(matches: DataFrame, sees: DataFrame, least_places: int = 2, least_span: float = 900.0) -> DataFrame:
    """(subject, places, span, sees, score) of entities met at enough distinct operator visits over enough time."""
    g = matches.groupBy("subject").agg(
        F.countDistinct("op_enter", "op_cluster").alias("places"), (F.max(F.coalesce("exit_ts", "enter_ts")) - F.min("enter_ts")).alias("span")
    ).where((F.col("places") >= least_places) & (F.col("span") >= least_span))
    score = F.least(F.lit(1.0), F.col("places") / 5 * 0.5 + F.least(F.col("span") / 3600, F.lit(6.0)) / 12 + F.least("sees", F.lit(20)) / 40)
    return g.join(sees, "subject").select("subject", "places", "span", "sees", F.round(score, 6).alias("score"))


def density(v: DataFrame, sightings: DataFrame, operator: int, radius: float = MERGE_M, around: float = 300.0, slot: float = 3600.0) -> DataFrame:
    """(subject, visit, others): distinct subjects, other than the visitor and the operator, seen within the radius and the time around each visit; 0 if
    there is none. Each sighting takes the cells that it reaches, the visits their own one, and the time slots of their time.

    A subject with one sighting in the cell in a visit's time is counted at once; only those with several are told apart, so that what is shuffled after the
    join is the visits and a few of the pairs."""
    s = sightings.where((F.col("subject") != operator) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    s = s.select(F.col("subject").alias("other"), F.col("ts").alias("s_ts"), F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    s = s.withColumn("_cell", F.explode(cells_near("s_lat", "s_lon", radius)))
    one = Window.partitionBy("other", "_cell").orderBy("s_ts")
    s = s.withColumns({"_before": F.lag("s_ts").over(one), "_after": F.lead("s_ts").over(one), "_slot": F.floor(F.col("s_ts") / slot)})
    w = v.select("subject", "visit", "lat", "lon", (F.col("enter_ts") - around).alias("_from"), (F.coalesce("exit_ts", "enter_ts") + around).alias("_to"))
    w = w.withColumn("_cell", cell("lat", "lon")).withColumn("_slot", F.explode(_slots(F.col("_from"), F.col("_to"), slot)))
    near = w.join(s, ["_cell", "_slot"]).where((F.col("other") != F.col("subject")) & F.col("s_ts").between(F.col("_from"), F.col("_to")))
    alone = F.coalesce(F.col("_before") < F.col("_from"), F.lit(True)) & F.coalesce(F.col("_after") > F.col("_to"), F.lit(True))
    near = near.where(haversine("lat", "lon", "s_lat", "s_lon") <= radius).select("subject", "visit", alone.cast("long").alias("_one"), F.when(~alone, F.col("other")).alias("other"))
    none = v.select("subject", "visit", F.lit(0).cast("long").alias("_one"), F.lit(None).cast(s.schema["other"].dataType).alias("other"))
    g = near.unionByName(none).groupBy("subject", "visit").agg(F.sum("_one").alias("_ones"), F.countDistinct("other").alias("_several"))
    return g.select("subject", "visit", (F.col("_ones") + F.col("_several")).alias("others"))


def nearest_place(points: DataFrame, places: list[tuple], hour: F.Column) -> DataFrame:
    """points (lat, lon, ...) with place: the nearest configured place (name, lat, lon, radius, from_hour, to_hour) in reach and open, the first on ties."""
    best = F.lit(None).cast("struct<d:double,o:int,place:string>")
    for i, (name, lat, lon, radius, a, b) in enumerate(places):
        d = haversine("lat", "lon", F.lit(float(lat)), F.lit(float(lon)))
        here = F.struct(d.alias("d"), F.lit(i).alias("o"), F.lit(name).alias("place"))
        ok = (d <= radius) & (hour >= a) & (hour < b)
        best = F.when(ok & (best.isNull() | (d < best["d"])), here).otherwise(best)
    return points.withColumn("place", best["place"])


def _thinned(metres_apart: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, prev = object(), None
        for f in frames:
            keep = []
            for s, lat, lon in zip(f["subject"].tolist(), f["lat"].tolist(), f["lon"].tolist()):
                if s != subject:
                    subject, prev = s, None
                ok = prev is None or math.hypot(lat - prev[0], lon - prev[1]) * 111000 >= metres_apart
                if ok:
                    prev = (lat, lon)
                keep.append(ok)
            yield f[np.array(keep, bool)]

    return run


def thin(points: DataFrame, metres_apart: float = 50.0) -> DataFrame:
    """Points at least so far from the last one kept, per subject in order of ts."""
    s = points.repartition("subject").sortWithinPartitions("subject", "ts", "id")
    return s.mapInPandas(_thinned(metres_apart), s.schema)


def with_place_id(df: DataFrame) -> DataFrame:
    return df.withColumn("place_id", place_id("lat", "lon"))


#: Fixed value: places that the live registry remembers.
MOST_ANCHORS = 512


def _registered(radius: float, most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        registry, anchors = object(), []
        for f in frames:
            la, lo, new = [], [], []
            for r, lat, lon, ts in zip(f["registry"].tolist(), f["lat"].tolist(), f["lon"].tolist(), f["ts"].tolist()):
                if r != registry:
                    registry, anchors = r, []
                d = metres(np.array([a[0] for a in anchors]), np.array([a[1] for a in anchors]), lat, lon) if anchors else np.zeros(0)
                near = np.flatnonzero(d <= radius)
                if len(near):
                    a = anchors[int(near[0])]
                    a[2] = ts
                else:
                    a = [lat, lon, ts]
                    anchors.append(a)
                    if len(anchors) > most:
                        anchors.sort(key=lambda x: x[2])
                        anchors.pop(0)
                la.append(a[0])
                lo.append(a[1])
                new.append(not len(near))
            yield f.assign(place_lat=la, place_lon=lo, is_new=new)

    return run


def place_registry(points: DataFrame, radius: float = MERGE_M, most: int = MOST_ANCHORS) -> DataFrame:
    """points (registry, ts, id, lat, lon, ...) with place_lat, place_lon, is_new: in time order a point belongs to the first remembered place within the
    radius, or makes a new one; beyond `most` the place seen longest ago is forgotten. State per registry is bounded."""
    s = points.where("lat is not null and lon is not null").repartition("registry").sortWithinPartitions("registry", "ts", "id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema)
    return s.mapInPandas(_registered(radius, most), f"{schema}, place_lat double, place_lon double, is_new boolean")


def best_fixes(located: DataFrame, cycle: F.Column) -> DataFrame:
    """(cycle, ts, id, lat, lon): of each cycle's located rows the newest, the first filed on ties: the operator's fix."""
    g = located.where("lat is not null and lon is not null").groupBy(cycle.alias("cycle")).agg(F.max(F.struct("ts", (-F.col("id")).alias("o"), "lat", "lon")).alias("b"))
    return g.select("cycle", "b.ts", (-F.col("b.o")).alias("id"), "b.lat", "b.lon")


def operator_path(fixes: DataFrame, radius: float = MERGE_M, most: int = MOST_ANCHORS) -> DataFrame:
    """fixes (registry, cycle, ts, id, lat, lon) at which the operator's place differs from that of the fix before."""
    p = place_registry(fixes, radius, most)
    w = Window.partitionBy("registry").orderBy("ts", "id")
    before = F.lag(F.struct("place_lat", "place_lon")).over(w)
    return p.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.struct("place_lat", "place_lon"))).drop("_b")


def sightings(rows: DataFrame) -> DataFrame:
    """Rows that have a place."""
    return rows.where("lat is not null and lon is not null")
