"""Queries that run as streams to their end, with the DuckDB oracles of what they come to."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysift.operators import incidents, radio
from skysift.plans.catalog import _DE, DAY, OPERATOR, ORACLES, _visits, query
from skysift.sources.bindings import observations
from skysift.streaming import live

#: Frames come in up to two days late, and a memory of three days holds them.
_MEMORY = f"""{_DE}, ar AS (SELECT target, source, ts, channel, floor(ts / {DAY})::BIGINT + id % 3 AS cycle, floor(ts * 10 + 0.5) AS tenth FROM de),
fr AS (SELECT target, source, min(struct_pack(cycle := cycle, ts := ts, channel := channel)) AS e FROM ar GROUP BY target, source, tenth),
me AS (SELECT c.target, c.source, c.cycle, f.e.ts AS ts, f.e.channel AS channel FROM (SELECT DISTINCT target, source, e.cycle AS cycle FROM fr) c JOIN fr f ON f.target = c.target AND f.source = c.source AND f.e.cycle <= c.cycle AND floor((f.e.ts + 3 * {DAY}) / {DAY}) >= c.cycle)
SELECT target, source, cycle, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM me GROUP BY ALL HAVING count(*) >= 2"""


def _frames(o):
    e = o.where("kind = 'error'").select(F.col("subject").alias("target"), (F.col("k") % 7).cast("long").alias("source"), "ts", (F.col("k") % 11 + 1).alias("channel"), "id")
    return e.withColumn("cycle", F.floor(F.col("ts") / DAY) + F.col("id") % 3).drop("id")


def _joined(a):
    return a.withColumn("channels", F.array_join(F.transform("channels", lambda c: c.cast("string")), ","))


@query(f"+ {_MEMORY}")
def attack_memory(spark, d):
    """What the attack memory holds at each cycle in which frames came in."""
    return _joined(radio.attacks_in_memory(_frames(observations(spark, d)), DAY, 3 * DAY, 2))


@query(f"+ {_MEMORY}")
def attack_memory_stream(spark, d):
    """The same from a stream that keeps the memory as state."""
    return _joined(live.finished(live.attack_stream(_frames(observations(spark, d, True)), DAY, 3 * DAY, 2)))


def _lines(o):
    kinds = F.array(*(F.lit(k) for k in list(incidents.WEIGHTS)))
    lines = o.select(
        F.concat(F.lit("ph:dev:"), F.col("subject").cast("string")).alias("phenomenon"), F.floor(F.col("ts") / DAY).cast("long").alias("cycle"), F.col("kind").alias("detector"),
        F.get(kinds, F.col("k") % 9).alias("kind"), F.col("id").cast("string").alias("detail"),
    )
    return incidents.weigh(lines).withColumn("contra", F.col("kind") == "density")


@query(ORACLES["incident_lifecycle"], obs=False)
def lifecycle_stream(spark, d):
    """The states of all phenomena after each cycle with evidence, from a stream with timers (M12); what timers add in between is left to the tests."""
    o = observations(spark, d)
    states = live.finished(live.lifecycle_stream(_lines(observations(spark, d, True)), DAY, 2 * DAY, 5 * DAY))
    own = o.select(F.concat(F.lit("ph:dev:"), F.col("subject").cast("string")).alias("phenomenon"), F.floor(F.col("ts") / DAY).cast("long").alias("cycle"))
    return states.join(own, ["phenomenon", "cycle"], "left_semi")


@query(f"+ s AS (SELECT DISTINCT subject, floor(ts / {DAY})::BIGINT AS slot FROM obs) SELECT a.subject, a.slot, ['5-10', '10-15', '15-20'][a.slot - b.slot] AS label, ['watch', 'watch', 'alert'][a.slot - b.slot] AS severity FROM s a JOIN s b ON a.subject = b.subject AND a.slot - b.slot BETWEEN 1 AND 3")
def reappearance_stream(spark, d):
    """Every slot of a subject that meets one of the three before it, from a stream that keeps the slots as state (M7)."""
    return live.finished(live.reappearance_stream(observations(spark, d, True), DAY))


@query(ORACLES["cotravel_matches"], obs=False)
def cotravel_stream(spark, d):
    """Co-travel matches from a stream-stream join of the entities' visits and the operator's."""
    path = live.shared_folder(spark)
    _visits(spark, d).withColumn("side", F.when(F.col("subject") == OPERATOR, "operator").otherwise("entities")).write.partitionBy("side").parquet(path)
    schema = spark.read.parquet(f"{path}/side=entities").schema
    entities, operator = (spark.readStream.schema(schema).parquet(f"{path}/side={side}") for side in ("entities", "operator"))
    met = live.finished(live.cotravel_stream(entities, operator, "3650 days", gap=5 * DAY))
    return met.select("subject", "visit", "op_visit", "enter_ts", "op_enter")
