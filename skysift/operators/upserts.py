"""Keyed upserts as grouped folds in filing order, and the reports that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entities(rows: DataFrame, keys: list[str], seq: str = "id") -> DataFrame:
    """first_seen is the least time; last_seen that of the newest filing, not the greatest; meta, if rows have it, the newest that is not null."""
    meta = [F.max_by("meta", F.when(F.col("meta").isNotNull(), F.col(seq))).alias("meta")] if "meta" in rows.columns else []
    return rows.groupBy(*keys).agg(F.min("ts").alias("first_seen"), F.max_by("ts", seq).alias("last_seen"), F.count("*").alias("see_count"), *meta)


def contributions(rows: DataFrame, keys: list[str], seq: str = "id") -> DataFrame:
    """hits, least and greatest time; the first detail sticks."""
    return rows.groupBy(*keys).agg(F.count("*").alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("detail", seq).alias("detail"))


def location_sightings(rows: DataFrame, keys: list[str], seq: str = "id") -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("ts").alias("first_seen"), F.max_by("ts", seq).alias("last_seen"), F.max_by("lat", seq).alias("lat"), F.max_by("lon", seq).alias("lon"), F.count("*").alias("see_count"))


def multi_location(sightings: DataFrame, least: int = 2, n: int = 15) -> DataFrame:
    """The subjects seen at most places."""
    g = sightings.groupBy("subject").agg(F.countDistinct("location").alias("locations"), F.sum("see_count").alias("sees")).where(F.col("locations") >= least)
    return g.orderBy(F.desc("locations"), F.desc("sees"), "subject").limit(n)


def links(rows: DataFrame) -> DataFrame:
    """Entity to fingerprint: confidence only rises."""
    return rows.groupBy("entity", "fingerprint").agg(F.max("confidence").alias("confidence"), F.min("ts").alias("linked_ts"))


def purge(rows: DataFrame, now: float, days: float) -> DataFrame:
    return rows.where(F.col("ts") >= now - days * 86400)


def pinned(entities_: DataFrame, now: float, days: float, *holders: DataFrame) -> DataFrame:
    """Entities past retention that nothing refers to: the ones to purge."""
    old = entities_.where(F.col("last_seen") < now - days * 86400)
    for h in holders:
        old = old.join(h, "subject", "left_anti")
    return old
