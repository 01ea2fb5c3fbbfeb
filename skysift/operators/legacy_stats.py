"""Whole-capture statistics: persistence, timing, places, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysift.operators import pairs


def hour_of(ts: str) -> F.Column:
    """Hour of day of epoch seconds, in UTC."""
    return F.floor(F.pmod(F.floor(F.col(ts)), F.lit(86400)) / 3600).cast("int")


def weekday_of(ts: str) -> F.Column:
    """Monday is 0."""
    return F.pmod(F.floor(F.col(ts) / 86400) + 3, F.lit(7)).cast("int")


def persistence(a: DataFrame, place: str) -> DataFrame:
    g = a.groupBy("subject").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct(place).alias("places"))
    g = g.withColumn("span_h", (F.col("last_ts") - F.col("first_ts")) / 3600)
    rate = F.try_divide(F.col("n").cast("double"), F.col("span_h"))
    base = F.when((F.col("n") >= 3) & (F.col("span_h") >= 1) & (rate >= 0.5), F.least(rate / 2, F.lit(1.0))).otherwise(0.0)
    score = F.when((base > 0) & (F.col("places") > 1), F.least(base + 0.3, F.lit(1.0))).otherwise(base)
    return g.withColumn("score", F.round(score, 6))


def gaps(a: DataFrame) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("ts", "id")
    return a.withColumn("gap", F.col("ts") - F.lag("ts").over(w))


def temporal(a: DataFrame) -> DataFrame:
    """Shares of work and off hours, weekdays and weekends, and how even the gaps are, per subject."""
    h = hour_of("ts")
    d = gaps(a).withColumns({"h": h, "wd": weekday_of("ts")})
    g = d.groupBy("subject").agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("h").between(9, 17), 1.0).otherwise(0.0)).alias("work_ratio"), F.avg(F.when((F.col("h") >= 22) | (F.col("h") <= 6), 1.0).otherwise(0.0)).alias("off_ratio"),
        F.count_if(F.col("wd") < 5).alias("weekdays"), F.count_if(F.col("wd") >= 5).alias("weekends"), F.avg("gap").alias("mean_gap"), F.var_pop("gap").alias("var_gap"),
    )
    week = F.when(F.col("weekdays") > 2 * F.col("weekends"), "weekday").when(F.col("weekends") > F.col("weekdays"), "weekend").otherwise("mixed")
    return g.select("subject", "n", F.round("work_ratio", 6).alias("work_ratio"), F.round("off_ratio", 6).alias("off_ratio"), ((F.col("n") >= 3) & (F.col("var_gap") < 0.1 * F.col("mean_gap"))).alias("regular"), week.alias("week"))


def quick_moves(a: DataFrame, place: str, seconds: float) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("ts", "id")
    d = a.withColumns({"_p": F.lag(place).over(w), "_t": F.lag("ts").over(w)})
    return d.where((F.col("_p") != F.col(place)) & (F.col("ts") - F.col("_t") < seconds)).groupBy("subject").agg(F.count("*").alias("moves"))


def hotspots(a: DataFrame, place: str, least: int = 2) -> DataFrame:
    return a.groupBy(place).agg(F.countDistinct("subject").alias("subjects"), F.count("*").alias("n")).where(F.col("subjects") >= least)


def correlations(a: DataFrame, place: str, seconds: float, least: int = 3) -> DataFrame:
    """Pairs seen at one place within `seconds` of each other at least so often; counted block against block, as crowds have more meetings than a shuffle holds."""
    met = pairs.meetings(a.select(F.col("subject").alias("key"), F.col(place).alias("place"), F.col("ts").cast("double").alias("ts")), seconds, least)
    return met.select(F.col("key_a").alias("subject"), F.col("key_b").alias("other"), F.col("n").alias("together"))


def stalking(scores: DataFrame, least_score: float = 0.7) -> DataFrame:
    s = F.when(F.col("places") >= 3, 0.4).otherwise(0.0) + F.when(F.col("n") >= 10, 0.3).otherwise(0.0) + F.when(F.col("span_h") >= 24, 0.3).otherwise(0.0)
    return scores.where(F.col("score") >= least_score).withColumn("stalking", F.round(s, 6)).where("stalking >= 0.6")


def heatmap(scores: DataFrame, seen: DataFrame, place: str) -> DataFrame:
    d = seen.select("subject", place).distinct().join(scores.select("subject", "score"), "subject")
    g = d.groupBy(place).agg(F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("max_score"), F.count("*").alias("subjects"))
    return g.withColumn("radius", F.least(F.greatest(50 * F.col("subjects"), F.lit(100)), F.lit(500)))


def probe_stats(a: DataFrame, ssid: str) -> DataFrame:
    return a.groupBy(ssid).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
