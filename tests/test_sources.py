"""Readers and writers where a wrong guess loses rows: ignore lists, probe logs, replaced files, evidence texts."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from skysift.operators import reports
from skysift.sources import captures, sinks


@pytest.mark.parametrize(
    "text, names",
    [
        ('["Bob\'s wifi", "home"]', ["BOB'S WIFI", "HOME"]),
        ("""ssids = ["Bob's wifi", 'say "hi"', 'it\\'s', ]""", ["BOB'S WIFI", "IT'S", 'SAY "HI"']),
        ("['a#b', # a comment with 'quotes'\n 'c']\n", ["A#B", "C"]),
        ('["a\\u00e9", " b ", "", "b"]', ["AÉ", "B"]),
        ("x = []", []), ("[]", []), ("names = ['one']", ["ONE"]),
    ],
)
def test_ignore_list(spark, tmp_path, text, names):
    (tmp_path / "list").write_text(text, encoding="utf-8")
    assert sorted(r.subject for r in captures.ignore_list(spark, str(tmp_path / "list")).collect()) == names


@pytest.mark.parametrize("text", ["nothing here", "['open", "[one, two]", '["a" "b"]', "{'a': 1}"])
def test_ignore_list_that_is_none(spark, tmp_path, text):
    """A list that cannot be read is an error, never an empty list."""
    (tmp_path / "list").write_text(text)
    with pytest.raises(Exception, match="no list of names"):
        captures.ignore_list(spark, str(tmp_path / "list")).collect()


def test_probe_log_read_in_pieces(spark, tmp_path):
    """A stamp holds until the next one, wherever the file is split."""
    lines, want = [], []
    for i in range(3000):
        if i % 7 == 0:
            lines.append(f"2024-01-{i % 28 + 1:02d} 10:00:{i % 60:02d} start")
            stamp = lines[-1][:19]
        else:
            lines.append(f"Probing for: net{i}")
            want.append((i, stamp, f"net{i}"))
    (tmp_path / "p.log").write_text("\n".join(lines))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "3000")
    try:
        log = captures.probe_log(spark, str(tmp_path / "p.log"))
        assert spark.read.text(str(tmp_path / "p.log")).rdd.getNumPartitions() > 10
        assert sorted((r.line, r.stamp, r.ssid) for r in log.collect()) == want
    finally:
        spark.conf.set(key, before)


def test_status_is_there_at_every_moment(spark, tmp_path):
    path, gone, over = str(tmp_path / "status.json"), [], threading.Event()
    sinks.publish_status(spark.createDataFrame([("clear", 0)], "state string, n int"), path)

    def watch():
        while not over.is_set():
            try:
                with open(path) as f:
                    json.loads(f.read())
            except Exception as e:
                gone.append(e)

    reader = threading.Thread(target=watch)
    reader.start()
    for n in range(8):
        sinks.publish_status(spark.createDataFrame([("alert", n)], "state string, n int"), path)
    over.set()
    reader.join()
    assert gone == [] and spark.read.json(path).first().n == 7
    sinks.save_ignore_list(spark.createDataFrame([("b'c",), ("A",), ("A",)], "subject string"), str(tmp_path / "ignore"))
    assert sorted(r.subject for r in captures.ignore_list(spark, str(tmp_path / "ignore")).collect()) == ["A", "B'C"]


def test_status_that_cannot_be_placed_is_parked(spark, tmp_path):
    path = tmp_path / "status.json"
    os.makedirs(path / "in the way")
    with pytest.raises(Exception):
        sinks.publish_status(spark.createDataFrame([("alert",)], "state string"), str(path))
    assert json.loads((tmp_path / "status.json.parked").read_text()) == {"state": "alert"}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["status.json", "status.json.parked"]


def test_fusion_in_any_evidence(spark):
    texts = ["{}", '{"fusion": {"old": 1}, "a": "}"}', '{"a": {"b": [1, 2.5, null, "\\u00e9"]}} ', "not json", None, "[1]"]
    fields = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "subject string, evidence_json string")
    blocks = spark.createDataFrame([(str(i), 0.5) for i in range(6)], "subject string, c double").select("subject", F.struct(F.col("c").alias("confidence")).alias("fusion"))
    got = [r.evidence_json for r in reports.attach_fusion(fields, blocks, ["subject"]).orderBy("subject").collect()]
    f = {"confidence": 0.5}
    assert [json.loads(x) for x in got[:3]] == [{"fusion": f}, {"a": "}", "fusion": f}, {"a": {"b": [1, 2.5, None, "é"]}, "fusion": f}]
    assert got[3:] == texts[3:]
