"""Incidents: deduplication, lifecycle, fusion by subject, status roll-up."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysift.functions.columns import fused

#: Weight of each kind of evidence, and kinds that do not count as independent.
WEIGHTS = {"deauth_pattern": 0.35, "attack_signature": 0.20, "source_severity": 0.15, "rogue_reason": 0.25, "ble_signal": 0.25, "copresence": 0.30, "travel_span": 0.25, "score": 0.10, "density": 0.06}
DEFAULT_WEIGHT = 0.10
SELF_REFERENCE = {"attack_signature", "score", "source_severity"}
REPETITION = {"mac_reappear", "ssid_probe_repeat"}
RANKS = ["NEW", "OBSERVING", "WATCH", "ALERT"]


def episodes(detections: DataFrame, keys: list[str], close_after: float = 600.0) -> DataFrame:
    """(keys, episode, n, first_ts, last_ts): an incident takes repeated detections until `close_after` passes without one, then it reopens."""
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    d = detections.withColumn("_new", F.when(F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > close_after), 1).otherwise(0))
    d = d.withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "episode").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def weigh(evidence: DataFrame, default: float = DEFAULT_WEIGHT) -> DataFrame:
    """evidence (kind, ...) with w: the kind's weight or the default."""
    w = F.lit(default)
    for kind, weight in WEIGHTS.items():
        w = F.when(F.col("kind") == kind, F.lit(weight)).otherwise(w)
    return evidence.withColumn("w", w)


def fuse_by(evidence: DataFrame, keys: list[str], cap: float = 0.99) -> DataFrame:
    """evidence (keys, kind, detail, w, contra) -> (keys, confidence, kinds, may_alert)."""
    line = F.struct("kind", "detail", "w")
    independent = F.when(~F.col("contra") & F.col("kind").isin([k for k in WEIGHTS if k not in SELF_REFERENCE]), F.col("kind"))
    g = evidence.groupBy(*keys).agg(F.collect_list(F.when(~F.col("contra"), line)).alias("_for"), F.collect_list(F.when(F.col("contra"), line)).alias("_against"), F.count_distinct(independent).alias("kinds"))
    return g.select(*keys, fused("_for", "_against", cap).alias("confidence"), "kinds", (F.col("kinds") >= 2).alias("may_alert"))


def gated(confidence, may_alert) -> F.Column:
    """alert, watch or info; an alert needs two independent kinds of evidence."""
    c, m = (F.col(x) if isinstance(x, str) else x for x in (confidence, may_alert))
    return F.when((c >= 0.60) & m, "alert").when(c >= 0.30, "watch").otherwise("info")


#: States that an incident is closed in, and for how long evidence on it is only noted.
CLOSED = ("RESOLVED", "FALSE_POSITIVE", "KNOWN_DEVICE")
REOPEN_RESOLVED_S, REOPEN_DISPOSED_S = 0.0, 604800.0


class Lifecycle:
    """State of one phenomenon over its cycles. Evidence moves it one rank at a time; silence lets it decay, then resolve; a disposition closes it, and
    evidence then is noted until the window is over and opens it anew."""

    def __init__(self, decay: float = 120.0, close: float = 600.0, reopen_resolved: float = REOPEN_RESOLVED_S, reopen_disposed: float = REOPEN_DISPOSED_S):
        self.decay, self.close = decay, close
        self.windows = dict(zip(CLOSED, (reopen_resolved, reopen_disposed, reopen_disposed)))
        self.state, self.confidence, self.last, self.closed, self.detectors, self.contributions = None, 0.0, None, None, set(), set()

    @staticmethod
    def fuse(lines: list[tuple[str, str, float, bool]]) -> tuple[float, int]:
        keep, shrink = 1.0, 1.0
        for kind, _, w, contra in sorted(lines):
            if contra:
                shrink *= 1 - abs(w)
            else:
                keep *= 1 - w
        kinds = {k for k, _, _, contra in lines if not contra and k in WEIGHTS and k not in SELF_REFERENCE}
        return math.floor(max(0.0, min((1 - keep) * shrink, 0.99)) * 1e6 + 0.5) / 1e6, len(kinds)

    def silent(self, now: float) -> None:
        """A cycle without evidence. A NEW phenomenon has no way to resolved and stays NEW."""
        if self.state in (None, "NEW", *CLOSED):
            return
        gone = now - self.last
        if gone > self.close:
            self.state, self.closed = "RESOLVED", now
        elif gone > self.decay and self.state in ("ALERT", "WATCH"):
            self.state = RANKS[RANKS.index(self.state) - 1]

    def dispose(self, now: float, what: str) -> None:
        """The operator closes it; what is closed or unknown stays as it is, and a NEW one can't be resolved."""
        if self.state in RANKS and what in CLOSED and (self.state, what) != ("NEW", "RESOLVED"):
            self.state, self.closed = what, now

    def next_change(self, cycle: int, cycle_s: float) -> int | None:
        """The first later cycle whose clock moves the state, or ends the window of a closed one, if nothing comes meanwhile."""
        if self.state in (None, "NEW"):
            return None
        since, limit = (self.closed, self.windows[self.state]) if self.state in CLOSED else (self.last, self.close if self.state == "OBSERVING" else min(self.decay, self.close))
        k = max(cycle + 1, int((since + limit) // cycle_s))
        while k * cycle_s - since < limit or self.state not in CLOSED and k * cycle_s - since <= limit:
            k += 1
        return k

    def evidence(self, now: float, rows: list[tuple[str, list[tuple[str, str, float, bool]]]]) -> None:
        """A cycle with detections (detector, lines)."""
        self.silent(now)
        if self.state in CLOSED and now - self.closed < self.windows[self.state]:
            return
        if self.state is None or self.state in CLOSED:
            self.state, self.detectors, self.contributions = "NEW", set(), set()
        self.last = now
        for detector, lines in rows:
            self.detectors.add(detector)
            self.contributions |= {(detector, k) for k, *_ in lines}
        self.confidence, kinds = self.fuse([x for _, lines in rows for x in lines])
        alert = self.confidence >= 0.60 and kinds >= 2
        level = "alert" if alert else "watch" if self.confidence >= 0.30 else "info"
        if level == "alert" and len(self.detectors - REPETITION) >= 2:
            want = "ALERT"
        elif level in ("alert", "watch"):
            want = "WATCH"
        else:
            want = "OBSERVING" if len(rows) >= 2 or self.confidence >= 0.30 or len(self.contributions) >= 2 else "NEW"
        here, there = RANKS.index(self.state), RANKS.index(want)
        if there > here:
            self.state = RANKS[there]  # every rank between is passed in this cycle
        elif there < here:
            self.state = RANKS[max(there, 1)]


LIFECYCLE_SCHEMA = "phenomenon string, cycle long, state string, confidence double, detectors int"


def lifecycle(detections: DataFrame, cycle_s: float, decay: float = 120.0, close: float = 600.0, reopen_resolved: float = REOPEN_RESOLVED_S, reopen_disposed: float = REOPEN_DISPOSED_S) -> DataFrame:
    """detections (phenomenon, cycle, detector, kind, detail, w, contra[, action]) -> the state after each cycle that had evidence, or a row without a detector.

    Such rows let the clock tick, or, if action names one of CLOSED, dispose of the phenomenon before the cycle's evidence. Silent cycles in between are
    replayed by their clock (cycle x cycle_s); one ordered pass, only the current phenomenon's state is held."""
    cols = ["phenomenon", "cycle", "detector", "kind", "detail", "w", "contra", "action"]
    detections = detections if "action" in detections.columns else detections.withColumn("action", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine, cycle, rows, actions = None, None, None, {}, []

        def close_cycle():
            if actions:
                machine.silent(cycle * cycle_s)
            for action in actions:
                machine.dispose(cycle * cycle_s, action)
            if rows:
                machine.evidence(cycle * cycle_s, sorted((d, x) for d, x in rows.items()))
            elif not actions:
                machine.silent(cycle * cycle_s)
            return key, cycle, machine.state, machine.confidence, len(machine.detectors)

        for f in frames:
            out = []
            for p, c, d, kind, detail, w, contra, action in f[cols].itertuples(index=False):
                if key is not None and (p, c) != (key, cycle):
                    out.append(close_cycle())
                    rows, actions = {}, []
                if p != key:
                    machine, cycle = Lifecycle(decay, close, reopen_resolved, reopen_disposed), None
                if cycle is not None and c != cycle:
                    for silent in range(cycle + 1, min(c, cycle + 2 + int(close / cycle_s) + 1)):
                        machine.silent(silent * cycle_s)
                key, cycle = p, c
                if d is not None and d == d:
                    rows.setdefault(d, []).append((kind, detail, w, bool(contra)))
                elif action is not None and action == action:
                    actions.append(action)
            yield pd.DataFrame(out, columns=["phenomenon", "cycle", "state", "confidence", "detectors"])
        if key is not None:
            yield pd.DataFrame([close_cycle()], columns=["phenomenon", "cycle", "state", "confidence", "detectors"])

    s = detections.select(*cols).repartition("phenomenon").sortWithinPartitions("phenomenon", "cycle", "detector", "kind", "detail", "action")
    return s.mapInPandas(run, LIFECYCLE_SCHEMA)


def status_rollup(incidents: DataFrame, now: float, hold: float = 300.0) -> DataFrame:
    """One row: open watches and alerts within the hold, totals, and the state they make."""
    held = F.col("last_ts") >= now - hold
    a = incidents.agg(
        F.count_if(held & (F.col("severity") == "alert")).alias("alerts"), F.count_if(held & (F.col("severity") == "watch")).alias("watches"),
        F.count("*").alias("incidents"), F.max("last_ts").alias("last_ts"),
    )
    return a.withColumn("state", F.when(F.col("alerts") > 0, "alert").when(F.col("watches") > 0, "watch").otherwise("clear"))


def top_open(incidents: DataFrame, n: int) -> DataFrame:
    return incidents.orderBy(F.when(F.col("severity") == "alert", 0).otherwise(1), F.desc("last_ts"), "incident_key").limit(n)


def cursors(batches: DataFrame, keys: list[str], order: str, top: str) -> DataFrame:
    """batches (keys, order, top) with cursor, where consumption stands after each: never lowered."""
    return batches.withColumn("cursor", F.max(top).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
