"""Re-appearance across time slots, slot upkeep, deduplication and novelty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = {1: "5-10", 2: "10-15", 3: "15-20"}
SEVERITY = {"5-10": "watch", "10-15": "watch", "15-20": "alert"}


def ignore(df: DataFrame, ignored: DataFrame, on: str) -> DataFrame:
    """Rows whose subject is not on the ignore list. The list is configuration of bounded size; Spark broadcasts it below its threshold."""
    return df.join(ignored, on, "left_anti")


def reappearances(obs: DataFrame, width: float, subject: str = "subject") -> DataFrame:
    """(subject, label, severity, n, first_ts, last_ts): subjects seen in a slot of `width` seconds and in one of the three before it."""
    slots = obs.groupBy(subject, F.floor(F.col("ts") / width).alias("slot")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    past = slots.select(F.col(subject), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("back"), (F.col("slot") + F.col("back")).alias("slot"))
    label, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, v in LABELS.items():
        label = F.when(F.col("back") == k, v).otherwise(label)
    met = slots.join(past, [subject, "slot"]).withColumn("label", label)
    for k, v in SEVERITY.items():
        severity = F.when(F.col("label") == k, v).otherwise(severity)
    return met.groupBy(subject, "label").agg(F.sum("n").alias("n"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts")).withColumn("severity", severity)


def aged_slots(slots: DataFrame, now: float, width: float = 300.0, depth: int = 4) -> DataFrame:
    """Saved slots moved on by the time since they were saved; those past the depth go, equal ones merge."""
    moved = F.col("slot") + F.floor((F.lit(now) - F.col("saved_ts")) / width)
    return slots.withColumn("slot", moved.cast("long")).where(F.col("slot") < depth).drop("saved_ts").distinct()


def slot_labels(obs: DataFrame, now: float, minutes: float = 60.0) -> DataFrame:
    """A row for each closed time range that an observation lies in; one on a boundary lies in two."""
    ranges = F.array(*(F.struct(F.lit(i).alias("slot"), F.lit(now - (i + 1) * 5 * minutes).alias("lo"), F.lit(now - i * 5 * minutes).alias("hi")) for i in range(4)))
    return obs.withColumn("r", F.explode(F.filter(ranges, lambda r: (F.col("ts") >= r["lo"]) & (F.col("ts") <= r["hi"])))).select("*", "r.slot").drop("r")


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def advancing(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value exceeds all earlier ones of their key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.max(value).over(w)).where(F.col("_before").isNull() | (F.col(value) > F.col("_before"))).drop("_before")


def running_count(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def carried_forward(df: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """The nearest earlier non-null value of each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def _cooling(keys: list[str], ts: str, cooldown: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0.0
        for f in frames:
            keep = []
            for k, t in zip(f[keys].itertuples(index=False, name=None), f[ts].tolist()):
                ok = k != key or t - last >= cooldown
                if ok:
                    key, last = k, t
                keep.append(ok)
            yield f[np.array(keep, bool)]

    return run


def cooled(df: DataFrame, keys: list[str], ts: str, cooldown: float, order: list) -> DataFrame:
    """Rows that come at least `cooldown` after the last row of their key that was let through. Each depends on the ones kept before, so one ordered pass."""
    s = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return s.mapInPandas(_cooling(keys, ts, cooldown), s.schema)


def changes(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows that differ from the one before."""
    return df.withColumn("_prev", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(value))).drop("_prev")


def islands(df: DataFrame, keys: list[str], order: list, new: F.Column, name: str) -> DataFrame:
    """Numbers runs: a row for which `new` holds begins the next one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def global_rank(df: DataFrame, ts: str, width: float, ties: list[str], name: str) -> DataFrame:
    """Numbers all rows by time without one task for them all: ranks within time slots, on top of the counts of the slots before."""
    d = df.withColumn("_slot", F.floor(F.col(ts) / width))
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = d.groupBy("_slot").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_slot").orderBy(ts, *ties))
    return d.join(slots, "_slot").withColumn(name, (F.col("_before") + own).cast("long")).drop("_slot", "_before")


def slot_sets(slots: DataFrame, slot: str, subject: str) -> DataFrame:
    """(slot, subjects): each slot's subjects as a sorted array; a slot is as many as a cycle can hold."""
    return slots.groupBy(slot).agg(F.array_sort(F.collect_set(subject)).alias("subjects"))


def held_events(events: DataFrame, ts: str, now: float, every: float, clocks: int, ttl: float) -> DataFrame:
    """A row for each clock (now - clock * every) at which an event is still in a memory of `ttl` seconds."""
    age = (now - F.col(ts)) / every
    first, last = F.greatest(F.lit(0).cast("long"), F.floor(age - ttl / every) + 1), F.least(F.lit(clocks - 1).cast("long"), F.floor(age))
    held = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    return events.withColumn("clock", F.explode(held)).withColumn("clock", F.col("clock").cast("int"))
