"""Reads and folds over the engine's keyed tables: observations, entities, fingerprints, baselines, incidents, queue, runtime values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most rows of one observation read; states of a phenomenon that is not closed; retention by class, in days.
MOST_ROWS = 5000
ACTIVE = ["new", "observing", "watch", "alert"]
RETENTION_DAYS = {"observations": 7, "events": 7, "heartbeats": 14, "status_history": 30}


def query_observations(obs: DataFrame, limit: int = MOST_ROWS, since: float | None = None, until: float | None = None, **equal) -> DataFrame:
    """Rows that meet every condition that is given (columns by name, closed time range), by (ts, id); the limit is held within 1 and 5000."""
    for column, value in equal.items():
        if value is not None:
            obs = obs.where(F.col(column) == value)
    if since is not None:
        obs = obs.where(F.col("ts") >= since)
    if until is not None:
        obs = obs.where(F.col("ts") <= until)
    return obs.orderBy("ts", "id").limit(max(1, min(int(limit), MOST_ROWS)))


def point(df: DataFrame, column: str, value) -> DataFrame:
    """The rows of one key; the equality reaches the scan."""
    return df.where(F.col(column) == value)


def children(rows: DataFrame, parent: str, value, order: list[str]) -> DataFrame:
    """A parent's rows in their fixed order."""
    return point(rows, parent, value).orderBy(*order)


def first_reads(rows: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """Each key's oldest rows, as a capped history read gives them."""
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "id"))
    return rows.withColumn("_nr", nr).where(F.col("_nr") <= most).drop("_nr")


def hypotheses(h: DataFrame, status: str | None = None, key=None, limit: int = 100) -> DataFrame:
    """Standing hypotheses of a status or a key on either side, the surest first."""
    if status is not None:
        h = h.where(F.col("status") == status)
    if key is not None:
        h = h.where((F.col("key_a") == key) | (F.col("key_b") == key))
    return h.orderBy(F.desc("confidence"), "key_a", "key_b").limit(limit)


def fingerprint_members(links: DataFrame, entities: DataFrame) -> DataFrame:
    """(fingerprint, key): the identities linked to each fingerprint."""
    return links.join(entities, "entity_id").select("fingerprint", "key")


def identity_features(entities: DataFrame, links: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(kind, key, fingerprint, hash, features): what each identity has presented."""
    return entities.join(links, "entity_id").join(fingerprints, "fingerprint").select("kind", "key", "fingerprint", "hash", "features")


def latest(rows: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """The last write of each key."""
    return rows.groupBy(*keys).agg(F.max(F.struct(seq, *columns)).alias("_w")).select(*keys, *(f"_w.{c}" for c in columns))


def cotravel_upsert(rows: DataFrame, keys: list[str], seq: str = "id") -> DataFrame:
    """Standing co-travel: first_seen of the first filing, the rest of the last."""
    g = rows.groupBy(*keys).agg(F.min_by("first_seen", seq).alias("first_seen"), F.max(F.struct(seq, "last_seen", "location_count", "score")).alias("_w"))
    return g.select(*keys, "first_seen", "_w.last_seen", "_w.location_count", "_w.score")


def fingerprint_upsert(rows: DataFrame, keys: list[str], seq: str = "id") -> DataFrame:
    """Standing fingerprints: times of the first and last filing, features of the last."""
    return rows.groupBy(*keys).agg(F.min_by("ts", seq).alias("first_seen"), F.max_by("ts", seq).alias("last_seen"), F.max_by("features", seq).alias("features"))


def ignore_flags(control: DataFrame, keys: list[str], seq: str = "id") -> DataFrame:
    """control (keys, seq, ignore) -> the standing flag of each entity."""
    return latest(control, keys, seq, ["ignore"])


def not_ignored(rows: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(flags.where("ignore").select(*keys), keys, "left_anti")


def baselines(rows: DataFrame, keys: list[str], least: int = 3, seq: str = "id") -> DataFrame:
    """rows (keys, seq, ts, action) -> (keys, first_seen, last_seen, sightings, source) as sightings and commands leave it.

    action: see counts one; manual and mark_false lift the count to `least`; forget deletes what is there. source: the last command, else learned from
    `least` sightings on, else candidate."""
    every = Window.partitionBy(*keys)
    told = F.col("action").isin("manual", "mark_false")
    r = rows.withColumn("_gone", F.max(F.when(F.col("action") == "forget", F.col(seq))).over(every)).where((F.col("action") != "forget") & (F.col("_gone").isNull() | (F.col(seq) > F.col("_gone"))))
    r = r.withColumn("_told", F.min(F.when(told, F.col(seq))).over(every))
    seen = F.col("action") == "see"
    g = r.groupBy(*keys).agg(
        F.min_by("ts", seq).alias("first_seen"), F.max_by("ts", seq).alias("last_seen"), F.count_if(seen & (F.col("_told").isNull() | (F.col(seq) < F.col("_told")))).alias("_before"),
        F.count_if(seen & (F.col(seq) > F.col("_told"))).alias("_after"), F.max_by("action", F.when(told, F.col(seq))).alias("_source"),
    )
    n = F.when(F.col("_source").isNotNull(), F.greatest("_before", F.lit(least)) + F.col("_after")).otherwise(F.col("_before"))
    source = F.coalesce("_source", F.when(n >= least, "learned").otherwise("candidate"))
    return g.select(*keys, "first_seen", "last_seen", n.cast("long").alias("sightings"), source.alias("source"))


def list_baselines(b: DataFrame, place: str = "place") -> DataFrame:
    """Baselines that are learned or set by hand, by place, the last seen first."""
    return b.where("source <> 'candidate'").orderBy(place, F.desc("last_seen"), *[c for c in b.columns if c not in (place, "last_seen", "first_seen", "sightings", "source")])


def explain_suppression(subjects: DataFrame, flags: DataFrame, b: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """subjects (place, keys) with reasons, why a match of theirs would be suppressed."""
    x = subjects.join(flags.where("ignore").select(*keys, F.lit(True).alias("_i")), keys, "left")
    x = x.join(b.where("source <> 'candidate'").select(place, *keys, F.lit(True).alias("_b")), [place, *keys], "left")
    reasons = F.array_compact(F.array(F.when(F.col("_i"), "entity marked ignore / mark_false"), F.when(F.col("_b"), F.concat(F.lit("baseline for place="), F.col(place).cast("string")))))
    return x.select(*subjects.columns, reasons.alias("reasons"))


def open_by_state(incidents: DataFrame) -> DataFrame:
    return incidents.where("status = 'open' AND lifecycle_state IS NOT NULL").groupBy("lifecycle_state").agg(F.count("*").alias("n"))


def active_phenomena(incidents: DataFrame) -> DataFrame:
    return incidents.where(F.col("lifecycle_state").isin(ACTIVE)).orderBy("incident_key")


def phenomenon_key(kind: Column, subject: Column) -> Column:
    return F.concat(F.lit("ph:"), kind, F.lit(":"), subject.cast("string"))


def by_phenomenon(rows: DataFrame) -> DataFrame:
    """Detector rows (kind, subject, ts, suppressed) by phenomenon: how many, and the freshest evidence; suppressed ones are consumed without effect."""
    r = rows.where(~F.coalesce("suppressed", F.lit(False)))
    return r.groupBy(phenomenon_key(F.col("kind"), F.col("subject")).alias("phenomenon")).agg(F.count("*").alias("n"), F.max("ts").alias("freshest"))


def contribution_counts(rows: DataFrame, incident: str) -> DataFrame:
    """How many (detector, class of evidence) pairs have contributed to each incident."""
    return rows.groupBy(incident).agg(F.countDistinct("detector", "evidence_class").alias("contributions"))


def status_inputs(incidents: DataFrame, events: DataFrame, heartbeats: DataFrame, now: float, hold: float, component: str = "analyzer") -> DataFrame:
    """One row of all that a status is made of: lifecycle rows open within the hold and at all, suppressed ones, events of the hour, the last heartbeat."""
    live, held, shown = F.col("status") == "open", F.col("last_seen") >= now - hold, ~F.coalesce("suppressed", F.lit(False))
    count = lambda state, *more: F.count_if(live & shown & (F.col("lifecycle_state") == state) & (held if more else F.lit(True)))
    i = incidents.agg(
        count("watch", 1).alias("watch_open"), count("alert", 1).alias("alert_open"), count("watch").alias("watch_total"), count("alert").alias("alert_total"),
        F.count_if(live & ~shown & held).alias("suppressed_open"),
    )
    e = events.agg(F.count_if(F.col("ts") >= now - 3600).alias("events_last_hour"))
    h = heartbeats.where(F.col("component") == component).agg(F.max("ts").alias("last_heartbeat_ts"), F.max_by("ok", "ts").alias("last_heartbeat_ok"))
    return i.crossJoin(e).crossJoin(h)  # single rows of aggregates


def retained(tables: dict[str, DataFrame], now: float) -> dict[str, DataFrame]:
    """Each table without what its class no longer holds."""
    return {name: t.where(F.col("ts") >= now - RETENTION_DAYS[name] * 86400) for name, t in tables.items()}


def incident_rows(incidents: DataFrame, entities: DataFrame) -> DataFrame:
    """Incidents with their entity, in report order."""
    return incidents.join(entities, "entity_id").orderBy("incident_key")


def pending(queue: DataFrame, limit: int = 20) -> DataFrame:
    """The oldest messages that wait."""
    return queue.where("status = 'pending'").orderBy("created_ts", "id").limit(limit)


def flushed(queue: DataFrame, delivered: Column, now: float, most_attempts: int = 5, limit: int = 20) -> DataFrame:
    """The queue after one pass over its pending head: delivered ones are sent; others count an attempt and wait, or have failed once those are used up."""
    head = pending(queue, limit).select("id", F.lit(True).alias("_head"))
    q = queue.join(F.broadcast(head), "id", "left")  # twenty rows at most
    spent = F.col("_head") & (F.col("attempts") >= most_attempts)
    ok = F.col("_head") & ~spent & delivered
    status = F.when(spent, "failed").when(ok, "sent").otherwise(F.col("status"))
    touched = F.coalesce("_head", F.lit(False))
    return q.withColumns({
        "status": status, "sent_ts": F.when(ok, F.lit(now)).otherwise(F.col("sent_ts")), "attempts": F.col("attempts") + F.when(touched, 1).otherwise(0),
        "last_attempt": F.when(touched, F.lit(now)).otherwise(F.col("last_attempt")),
    }).drop("_head")
