"""Streams with state against their batch twins: silence, late rows, restarts, snapshots."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skysift.operators import geo, incidents, radio, windows
from skysift.streaming import live

EVIDENCE = "phenomenon string, cycle bigint, detector string, kind string, detail string, w double, contra boolean, action string"
FRAMES = "target bigint, source bigint, ts double, channel int, cycle bigint"


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, live.ROCKSDB)
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


class Feed:
    """A folder that grows; run() takes in what is new, a file a batch, under one checkpoint: each run is a restart."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.files = spark, folder, schema, 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.files += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")

    def run(self, out):
        q = out.writeStream.format("parquet").option("checkpointLocation", self.checkpoint).option("path", f"{self.folder}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        return q

    @property
    def checkpoint(self):
        return f"{self.folder}/checkpoint"

    def rows(self):
        return self.spark.read.parquet(f"{self.folder}/out").collect()


def seen(p, cycle, strong=True):
    """Two detectors' evidence, enough for an alert; or one's, enough to watch."""
    both = [(p, cycle, "deauth", "deauth_pattern", str(cycle), 0.35, False, None), (p, cycle, "cotravel", "copresence", str(cycle), 0.45, False, None)]
    return both if strong else both[:1]


def tick(cycle):
    return [(None, cycle, None, None, None, None, None, None)]


def act(p, cycle, what):
    return [(p, cycle, None, None, None, None, None, what)]


def with_ticks(spark, rows, last, **times):
    """The batch fold in which every phenomenon hears every tick up to `last`: rows of cycles with evidence or an action, and of changes."""
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[0]] = min(r[1], first.get(r[0], r[1]))
    heard = [r for r in rows if r[0] is not None]
    own = {(r[0], r[1]) for r in heard}
    heard += [(p, c, *[None] * 6) for p, f in first.items() for c in range(f, last + 1) if (p, c) not in own]
    states = incidents.lifecycle(spark.createDataFrame(heard, EVIDENCE), 60.0, **times)
    before = F.lag("state").over(Window.partitionBy("phenomenon").orderBy("cycle"))
    states = states.withColumn("before", before).collect()
    return sorted((r.phenomenon, r.cycle, r.state, r.confidence, r.detectors) for r in states if (r.phenomenon, r.cycle) in own or r.state != r.before)


def test_silence_decays_closes_and_reopens(spark, tmp_path):
    """Batches with and without ticks between them, restarts in between; every change comes out once, with the batch fold's cycle."""
    parts = [
        seen("a", 1) + seen("b", 1, False), seen("a", 2), tick(3), tick(4), tick(6), tick(30), seen("b", 31), tick(32) + seen("a", 33, False), tick(34), tick(70),
        seen("a", 71), act("a", 72, "FALSE_POSITIVE"), seen("c", 72) + act("c", 73, "KNOWN_DEVICE") + seen("c", 74), seen("b", 75), act("b", 76, "RESOLVED") + seen("b", 76), tick(90),
    ]
    feed = Feed(spark, tmp_path, EVIDENCE)
    for k, part in enumerate(parts):
        feed.put(part)
        if k % 4 != 3 and k + 1 < len(parts):
            continue
        s = feed.stream()
        feed.run(live.lifecycle_stream(s.where("phenomenon is not null"), 60.0, ticks=s.where("phenomenon is null"), reopen_disposed=600.0))
    got = sorted(tuple(r) for r in feed.rows())
    want = with_ticks(spark, [r for p in parts for r in p], 89, reopen_disposed=600.0)
    assert got == want
    states = [r[2] for r in want if r[0] == "a"]
    assert {"ALERT", "WATCH", "OBSERVING", "RESOLVED"} <= set(states)
    assert ("c", 74, "KNOWN_DEVICE") in {r[:3] for r in want}, "evidence inside the window is only noted"


def test_closed_phenomena_leave_the_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVIDENCE)
    for part in ([r for i in range(50) for r in seen(f"p{i}", 1)], tick(5), tick(40), tick(80)):
        feed.put(part)
    s = feed.stream()
    feed.run(live.lifecycle_stream(s.where("phenomenon is not null"), 60.0, ticks=s.where("phenomenon is null")))
    left = spark.read.format("statestore").option("path", feed.checkpoint).option("stateVarName", "machine").load()
    assert left.where("key.phenomenon is not null").count() == 0
    assert sum(r.state == "RESOLVED" for r in feed.rows()) == 50


def test_clock_next_change():
    """What next_change foretells is what cycle by cycle comes about."""
    rng = random.Random(3)
    for _ in range(300):
        times = (rng.choice([0, 45, 60, 120, 500]), rng.choice([60, 400, 600]), rng.choice([0, 300]), 900)
        m, cycle = incidents.Lifecycle(*map(float, times)), rng.randint(0, 5)
        m.evidence(cycle * 60.0, [("deauth", [("deauth_pattern", "", 0.35, False)]), ("cotravel", [("copresence", "", rng.choice([0.1, 0.45]), False)])])
        for c in range(cycle + 1, cycle + 40):
            due, before = m.next_change(c - 1, 60.0), m.state
            if before in incidents.CLOSED:
                assert due >= c and (due * 60 - m.closed >= m.windows[before])
                break
            m.silent(c * 60.0)
            assert (due == c) == (m.state != before)


def test_attack_memory(spark, tmp_path):
    """Frames in order, late, repeated and too old; in one run and with a restart after each file, and as the batch query."""
    rng = random.Random(7)
    parts = []
    for cycle in range(1, 60, 3):
        now = cycle * 60.0
        parts.append([(t, s, now - rng.choice([0, 1, 5, 30, 30.02, 400, 1750, 1900, 5000]) - rng.random(), rng.choice([1, 6, 11, None]), cycle) for t in range(3) for s in range(2) for _ in range(rng.choice([0, 1, 4]))])
    parts = [p for p in parts if p]
    everything = spark.createDataFrame([r for p in parts for r in p], FRAMES)
    want = sorted((r.target, r.source, r.cycle, r.n, r.first_ts, r.last_ts, r.channels) for r in radio.attacks_in_memory(everything, 60.0, 1800.0, 3).collect())
    assert len(want) > 20
    for name, each in (("whole", len(parts)), ("restarts", 9)):
        feed = Feed(spark, tmp_path / name, FRAMES)
        for k in range(0, len(parts), each):
            for p in parts[k : k + each]:
                feed.put(p)
            feed.run(live.attack_stream(feed.stream(), 60.0, 1800.0, 3))
        assert sorted(tuple(r) for r in feed.rows()) == want


def test_attack_memory_is_bounded(spark, tmp_path):
    """A flood holds ten frames a second at most; a pair that falls silent leaves nothing."""
    feed = Feed(spark, tmp_path, FRAMES)
    feed.put([(1, 1, 100.0 + i / 200, 6, 2) for i in range(4000)] + [(2, 1, 100.0, 6, 2)])
    feed.put([(1, 1, 2000.0, 6, 34)])
    feed.put([(9, 9, 3000.0, 6, 50)])
    feed.run(live.attack_stream(feed.stream(), 60.0, 1800.0, 1))
    left = spark.read.format("statestore").option("path", feed.checkpoint).option("stateVarName", "frames").load()
    assert {r.target: r.n for r in left.select("key.target", F.size("value.ts").alias("n")).collect()} == {1: 1, 9: 1}
    assert max(r.n for r in feed.rows()) == 201


@pytest.mark.parametrize("pause", [100.0, 700.0, 1600.0])
def test_snapshot_carries_slots_over(spark, tmp_path, pause):
    """A stream is stopped, its slots are saved, and a new stream without its checkpoint begins with them: it reports what the batch query finds for the
    uninterrupted rows. A snapshot that is too old is refused."""
    width, stop = 300.0, 6000.0
    schema = "subject bigint, ts double"
    first = [(s, stop - 10 - 300.0 * k) for s in range(8) for k in range(4) if (s >> k) & 1 or s == 7]
    later = [(s, stop + pause + 5) for s in range(8)]
    old = Feed(spark, tmp_path / "old", schema)
    old.put(first)
    old.run(live.reappearance_stream(old.stream(), width))
    snapshot = live.held_slots(spark, old.checkpoint, stop - 1, width)
    snapshot.write.parquet(str(tmp_path / "snapshot"))
    snapshot = spark.read.parquet(str(tmp_path / "snapshot"))
    assert {(r.subject, r.slot) for r in snapshot.collect()} == {(s, int((stop - 1) // width - t // width)) for s, t in first}
    new = Feed(spark, tmp_path / "new", schema)
    new.put(later)
    new.run(live.reappearance_stream(new.stream(), width, live.rehydrated(snapshot, stop - 1 + pause, width)))
    whole = spark.createDataFrame(first + later, schema).where(F.col("ts") > 0)
    past = windows.reappearances(spark.createDataFrame(first, schema), width)
    both = {(r.subject, r.label, r.n) for r in windows.reappearances(whole, width).collect()} - {(r.subject, r.label, r.n) for r in past.collect()}
    got = {(r.subject, r.slot, r.label) for r in new.rows()}
    assert {(s, label) for s, _, label in got} == {(s, label) for s, label, _ in both}
    assert {s for _, s, _ in got} <= {int((stop + pause + 5) // width)} and bool(got) == (pause < 1500)


VISITS = "subject bigint, visit bigint, cluster int, enter_ts double, exit_ts double, lat double, lon double, n bigint"


def walk(rng, subjects, hours):
    """Sightings of walkers who stay at one of five places for a while and move on; some of them walk with subject 0."""
    at, out = {}, []
    for minute in range(0, 60 * hours, 4):
        for s in range(subjects):
            if s not in at or rng.random() < 0.05:
                at[s] = rng.randrange(5)
            place = at[0] if s % 4 == 1 else at[s]
            if rng.random() < 0.6:
                out.append((s, 864000.0 + 60.0 * minute + s / 100, 33.4 + 0.01 * place + 0.00004 * rng.randrange(5), -112.0))
    return out


def test_visits_and_cotravel_of_streams(spark, tmp_path):
    """Sightings in shuffled files become the batch operator's visits; entity and operator visits as two streams meet as in the batch join, and the join's state
    does not keep what the watermark has passed."""
    rng = random.Random(11)
    rows = walk(rng, 8, 60)
    last = max(r[1] for r in rows)
    schema = "subject bigint, ts double, lat double, lon double"
    feed = Feed(spark, tmp_path / "sightings", schema)
    rows.sort(key=lambda r: r[1] // 1200)
    for k in range(0, len(rows), len(rows) // 5 + 1):
        part = rows[k : k + len(rows) // 5 + 1]
        rng.shuffle(part)
        feed.put(part)
    feed.put([(99, last + 90000.0, 33.4, -112.0)])
    feed.run(live.visit_stream(feed.stream(), lateness="20 minutes"))
    batch = geo.visits(geo.assign_clusters(spark.createDataFrame(rows, schema)))
    shape = lambda r: (r.subject, r.visit, r.cluster, r.enter_ts, r.lat, r.lon, r.n)
    found = feed.rows()
    assert sorted(map(shape, found)) == sorted(map(shape, batch.collect()))
    assert all(r.exit_ts >= r.enter_ts for r in found)

    over = spark.createDataFrame(found, VISITS).orderBy("enter_ts").collect()
    want = geo.cotravel(spark.createDataFrame([r for r in over if r.subject], VISITS), spark.createDataFrame([r for r in over if not r.subject], VISITS))
    pair = lambda r: (r.subject, r.visit, r.op_visit, r.enter_ts, r.op_enter)
    want = sorted(map(pair, want.collect()))
    sides = [Feed(spark, tmp_path / name, VISITS) for name in ("entities", "operator")]
    for k in range(6):
        day = [r for r in over if min(5, (r.exit_ts - 864000) // 43200) == k]
        for side, mine in zip(sides, ([r for r in day if r.subject], [r for r in day if not r.subject])):
            side.put([tuple(r) for r in mine])
    q = sides[0].run(live.cotravel_stream(sides[0].stream(), sides[1].stream(), "12 hours"))
    assert sorted(map(pair, sides[0].rows())) == want and len(want) > 50
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    assert held[-1] < max(held) and sum(o["numRowsRemoved"] for p in q.recentProgress for o in p["stateOperators"]) > 0


class _Held:
    """A processor's state and timers in plain variables."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter([(t,) for t in self.timers])

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_folds_of_a_key_make_no_tables(monkeypatch):
    """A key's rows are few and its keys many: no pandas grouping for each, and no table where nothing comes out."""
    import pandas as pd

    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    frames = live.Frames(60.0, 180.0, 2)
    frames.init(_Held())
    feed = lambda *r: [tuple(x) for f in frames.handleInputRows((1, 2), iter([pd.DataFrame(r, columns=["ts", "channel", "cycle"])]), None) for x in f.itertuples(index=False)]
    assert list(frames.handleInputRows((1, 2), iter([pd.DataFrame([(5.0, None, 0)], columns=["ts", "channel", "cycle"])]), None)) == []
    assert feed((70.0, 3, 1), (5.01, 4, 1), (61.0, None, 1), (1.0, 9, 0)) == [(1, 2, 0, 2, 1.0, 5.0, [9]), (1, 2, 1, 4, 1.0, 70.0, [3, 9])]
    machine = live.Phenomenon(60.0, True, 120.0, 600.0, 600.0, 600.0)
    machine.init(_Held())
    lines = pd.DataFrame([(1, "b", "movement", "x", 0.3, False, None), (0, "a", "movement", "x", 0.3, False, None), (1, None, None, None, None, None, None)], columns=["cycle", "detector", "kind", "detail", "w", "contra", "action"])
    assert [r.cycle for f in machine.handleInputRows(("p",), iter([lines]), None) for r in f.itertuples()] == [0, 1]
