"""The operator's hand in incidents: dispositions, reopening windows, allowed moves and the rows that a move leaves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Moves between states, the severity that a state shows, and how long a closed incident stays closed.
ALLOWED = {
    "new": ["observing", "false_positive", "known_device"],
    "observing": ["watch", "resolved", "false_positive", "known_device"],
    "watch": ["alert", "observing", "resolved", "false_positive", "known_device"],
    "alert": ["watch", "resolved", "false_positive", "known_device"],
    "resolved": ["new"], "false_positive": ["new"], "known_device": ["new"], "archived": [],
}
SEVERITY = {"new": "info", "observing": "info", "watch": "watch", "alert": "alert"}
DISPOSITIONS = ["resolved", "false_positive", "known_device"]
REOPEN_RESOLVED_S, REOPEN_DISPOSITION_S = 0.0, 604800.0


def validated(moves: DataFrame) -> DataFrame:
    """moves (from_state, to_state, ...) with valid: whether the move is one of the allowed."""
    ok = F.lit(False)
    for state, targets in ALLOWED.items():
        ok = ok | ((F.col("from_state") == state) & F.col("to_state").isin(targets)) if targets else ok
    return moves.withColumn("valid", F.coalesce(ok, F.lit(False)))


OUTCOME_SCHEMA = "outcome string, state string, note string"


def _handled(key: str, resolved_s: float, disposed_s: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, state, closed = object(), None, 0.0
        for f in frames:
            outcomes, states, notes = [], [], []
            for k, ts, action in zip(f[key].tolist(), f["ts"].tolist(), f["action"].tolist()):
                if k != subject:
                    subject, state, closed = k, None, 0.0
                note = None
                if action == "evidence":
                    if state is None:
                        state, outcome = "new", "opened"
                    elif state not in DISPOSITIONS:
                        outcome = "touched"
                    elif ts - closed < (resolved_s if state == "resolved" else disposed_s):
                        outcome, note = "noted", "evidence suppressed during reopen window"
                    else:
                        note, state, outcome = f"reopened: fresh evidence after {state}", "new", "reopened"
                elif state is None:
                    outcome = "unknown"
                elif state in DISPOSITIONS or action not in DISPOSITIONS or action == "resolved" and state == "new":
                    outcome = "invalid"
                else:
                    state, closed, outcome = action, ts, "disposed"
                outcomes.append(outcome)
                states.append(state)
                notes.append(note)
            yield f.assign(outcome=outcomes, state=states, note=notes)

    return run


def dispositions(rows: DataFrame, key: str, seq: str = "id", resolved_s: float = REOPEN_RESOLVED_S, disposed_s: float = REOPEN_DISPOSITION_S) -> DataFrame:
    """rows (key, ts, seq, action, ...) with outcome, state and note; action is evidence or a disposition.

    The first evidence finds no incident and opens one; later evidence touches it. A disposition closes an open incident; on a closed or unknown one it is
    invalid. Evidence on a closed incident is a note until its window is over, then it reopens as new. One ordered pass per key, constant state."""
    s = rows.repartition(key).sortWithinPartitions(key, "ts", seq)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema)
    return s.mapInPandas(_handled(key, resolved_s, disposed_s), f"{schema}, {OUTCOME_SCHEMA}")


def timeline(states: DataFrame, key: str, order: list[str]) -> DataFrame:
    """states (key, order, ts, state, ...) -> the moves: a row where the state differs from the one before, from_state null for the first."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    return states.withColumn("from_state", before).where(F.col("from_state").isNull() | (F.col("from_state") != F.col("state"))).withColumnRenamed("state", "to_state")


def applied(moves: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """What moves leave behind beside the timeline: (key, state, severity, status, closed_at) of each incident, and audit events (key, ts, event_type)."""
    severity = F.lit(None).cast("string")
    for state, level in SEVERITY.items():
        severity = F.when(F.col("to_state") == state, level).otherwise(severity)
    m = moves.withColumn("_severity", severity)
    w = F.struct(*order, "to_state", F.col("ts").alias("_at"))
    rows = m.groupBy(key).agg(F.max(w).alias("w"), F.max_by("_severity", F.when(F.col("_severity").isNotNull(), F.struct(*order))).alias("severity"))
    closed = F.col("w.to_state").isin(*DISPOSITIONS, "archived")
    rows = rows.select(key, F.col("w.to_state").alias("state"), "severity", F.when(closed, "closed").otherwise("open").alias("status"), F.when(closed, F.col("w._at")).alias("closed_at"))
    kind = F.when(F.col("from_state").isNull(), "incident_opened").when(F.col("from_state").isin(DISPOSITIONS), "incident_reopened").when(F.col("to_state").isin(DISPOSITIONS), "incident_closed").otherwise("incident_transition")
    return rows, m.select(key, "ts", kind.alias("event_type"))
