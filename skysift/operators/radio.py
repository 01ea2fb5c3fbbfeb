"""Detectors on radio events: deauthentication attacks, rogue access points, Bluetooth trackers, interference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysift.functions.columns import encryption_matches


def attacks(events: DataFrame, now: float, window: float = 1800.0, least: int = 5) -> DataFrame:
    """(target, source, n, first_ts, last_ts, channels) of the pairs with enough frames in the attack window."""
    e = events.where(F.col("ts") >= now - window)
    return e.groupBy("target", "source").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_sort(F.collect_set("channel")).alias("channels")
    ).where(F.col("n") >= least)


def attacks_in_memory(events: DataFrame, cycle_s: float, window: float = 1800.0, least: int = 5) -> DataFrame:
    """events (target, source, ts, channel, cycle) -> (target, source, cycle, n, first_ts, last_ts, channels): at each cycle in which a pair's frames came in,
    those that a memory of `window` seconds before its clock (cycle x cycle_s) holds, if they are enough. Frames of one tenth of a second count once, the
    first that came in; a frame that comes late is held from then on, if its time is still in the window."""
    tenth = F.floor(F.col("ts") * 10 + 0.5)
    first = events.withColumn("_tenth", tenth).groupBy("target", "source", "_tenth").agg(F.min(F.struct("cycle", "ts", "channel")).alias("e"))
    first = first.select("target", "source", "e.*")
    clocks = first.select("target", "source", F.col("cycle").alias("clock")).distinct()
    last = F.floor((F.col("ts") + window) / cycle_s)
    held = first.where(F.col("cycle") <= last).withColumn("clock", F.explode(F.sequence("cycle", last)))
    g = held.join(clocks, ["target", "source", "clock"]).groupBy("target", "source", F.col("clock").alias("cycle")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_sort(F.collect_set("channel")).alias("channels")
    )
    return g.where(F.col("n") >= least)


def peak_rates(events: DataFrame, seconds: int = 60) -> DataFrame:
    """(target, source, n, rate): the most frames in any closed window of `seconds`, per minute; fewer than two frames are their own rate."""
    w = Window.partitionBy("target", "source").orderBy("ts").rangeBetween(-seconds, 0)
    g = events.withColumn("_n", F.count("*").over(w)).groupBy("target", "source").agg(F.count("*").alias("n"), F.max("_n").alias("most"))
    return g.select("target", "source", "n", F.when(F.col("n") < 2, F.col("n").cast("double")).otherwise(F.col("most") * (60.0 / seconds)).alias("rate"))


def attack_severity(rates: DataFrame, burst: float, protected: F.Column) -> DataFrame:
    n, r = F.col("n"), F.col("rate")
    level = F.when((r > 5 * burst) | (protected & (n > 20)), "CRITICAL").when((r > 2 * burst) | (protected & (n > 10)), "HIGH").when((r > burst) | (n > 20), "MEDIUM").otherwise("LOW")
    return rates.withColumns({"severity": level, "attack_type": F.when(r > burst, "flood").otherwise("targeted")})


def new_radios(sightings: DataFrame) -> DataFrame:
    """(ssid, bssid, first_ts, nth): each network's radios in the order of first sight; the first is learned, later ones are news."""
    first = sightings.groupBy("ssid", "bssid").agg(F.min("ts").alias("first_ts"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("ssid").orderBy("first_ts", "bssid")))


def trusted_check(sightings: DataFrame, trusted: DataFrame) -> DataFrame:
    """(ssid, bssid, n, verdict): radios of trusted networks; CRITICAL if not known, MEDIUM if known but once seen with other encryption or another channel.

    trusted: (ssid, bssid), a row for each radio. encryption and channel are compared where both tables have them; null, empty or 0 is unknown."""
    traits = [c for c in ("encryption", "channel") if c in sightings.columns and c in trusted.columns]
    seen = sightings.groupBy("ssid", "bssid", *traits).agg(F.count("*").alias("n"))
    nets = trusted.select("ssid").distinct()
    known = trusted.select("ssid", "bssid", *(F.col(c).alias(f"_{c}") for c in traits), F.lit(True).alias("known"))
    differs = {
        "encryption": lambda: (F.col("_encryption") != "") & (F.col("encryption") != "") & ~encryption_matches("_encryption", "encryption"),
        "channel": lambda: (F.col("_channel") != 0) & (F.col("channel") != 0) & (F.col("_channel") != F.col("channel")),
    }
    changed = F.lit(False)
    for c in traits:
        changed = changed | F.coalesce(differs[c](), F.lit(False))
    v = F.when(F.bool_or(changed) & F.bool_or("known"), "MEDIUM").when(F.bool_or("known"), "trusted").otherwise("CRITICAL")
    return seen.join(nets, "ssid").join(known, ["ssid", "bssid"], "left").groupBy("ssid", "bssid").agg(F.sum("n").alias("n"), v.alias("verdict"))


def interference(rows: DataFrame) -> DataFrame:
    """Rows with retries above half of the frames sent and above fifty."""
    return rows.where((F.try_divide(F.col("retries"), F.col("tx")) > 0.5) & (F.col("retries") > 50))


def first_filings(attacks_: DataFrame, most: int = 20, last: bool = False) -> DataFrame:
    """The `most` attacks to file by severity, then target and source; or the last ones."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "HIGH", 1).when(F.col("severity") == "MEDIUM", 2).otherwise(3)
    order = [rank.desc(), F.desc("target"), F.desc("source")] if last else [rank, F.col("target"), F.col("source")]
    return attacks_.orderBy(*order).limit(most)
