"""Spelling variants against plain Python: runs, checksums, near words, forms and roots."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.llm import catalog, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def words_of(rows):
    n = Counter()
    for doc_id, text in rows:
        for r in RUN.findall(text or ""):
            w = lowered(r)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 3}


def neighbours(words):
    """Pairs one edit apart, by what is left when one code point goes."""
    left, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            left[i, w[:i] + w[i + 1 :]].add(w)
    for (_, less), group in left.items():
        for a in group:
            near[a] |= group - {a}
            if less in words:
                near[a].add(less)
                near[less].add(a)
    return near


def brute(rows):
    n = words_of(rows)
    near = neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_all_documents(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(catalog.queries()["op11_spelling_variants"](spark, data)) == want
    assert sum(r[1] is not None for r in want) > 20, "misprints have forms"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(con.execute(spelling.ORACLE).fetchall()) == want


@pytest.mark.parametrize("letters", ["ab", "abcé", "aeiou÷nrst"])
def test_near_words_of_few_letters(spark, letters):
    """Words full of repeated and common bigrams, where prefixes tie: no near pair is lost."""
    rng = random.Random(letters)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(600)}
    for w in list(words)[:200]:
        i = rng.randrange(len(w))
        words |= {w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]}
    want = {(a, b) for a, bs in neighbours(words).items() for b in bs}
    df = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long").repartition(3)
    pairs = [(r.word, r.near) for r in spelling.near_words(df).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_both_ways_of_comparing_agree(spark, monkeypatch):
    words = sorted({"".join(p) for k in (5, 6) for p in itertools.product("aé", repeat=k)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = {(a, b) for a, bs in neighbours(set(words)).items() for b in bs}
    for most in (0, 5, 64):
        monkeypatch.setattr(spelling, "COMPARED", most)
        assert {(r.word, r.near) for r in spelling.near_words(df).collect()} == want


def test_checksums():
    rng = random.Random(2)
    for _ in range(30):
        texts = ["".join(rng.choice("aBé× Ā\U0001f600z9") for _ in range(rng.choice([0, 1, 5, 300]))) for _ in range(6)]
        raw = [t.encode() for t in texts]
        starts = np.cumsum([0] + [len(x) for x in raw])
        low, begin, end, length, doc = spelling._runs(np.frombuffer(b"".join(raw), np.uint8), starts)
        want = [(k, lowered(r)) for k, t in enumerate(texts) for r in RUN.findall(t)]
        assert [(d, low[a:b].tobytes().decode()) for d, a, b in zip(doc.tolist(), begin, end)] == want
        assert length.tolist() == [len(w) for _, w in want]
        seed = np.array([zlib.crc32(b"%d:" % k) for k in range(6)], np.uint32)
        assert spelling._checksums(low, begin, end, seed[doc]).tolist() == [zlib.crc32(f"{k}:{w}".encode()) for k, w in want]


def test_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(5_000))
    rows = [(1, None), (2, ""), (None, "Spelling SPELLING spelling speling speling speling"), (3, "cafÉs cafÉs cafÉs cafés cafés cafés"), (4, f"{long} {long} {long} {long[:-1]}x"), (4, f"{long}"), (5, f"{long[:-1]}x {long[:-1]}x")]
    rows += [(6, "chains chainz chainzz\n" * 3 + "chains " * 30 + "chainz " * 9)] * 2 + [(7, "tiesa tiesb tiesc " * 3 + "tiesa tiesb " * 9), (8, "x" * 4 + " one two Āā 12345 \U0001f600")]
    rows += [(100 + i, "the quick brown foxes jumped over the lazy sleeping dogs") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    extra = df.select("*", *(F.lit(1).alias(c) for c in ("word", "n", "name", "form", "root", "near", "gram", "length", "a", "b")))
    assert got(spelling.variants(extra)) == want
    by = {r[0]: r for r in want}
    assert by["chainzz"][1:3] == ("chainz", "chains") and by["tiesc"][1] == "tiesa" and long in by
    for few in ([], [(1, None)], [(1, "one two")]):
        assert got(spelling.variants(spark.createDataFrame(few, "doc_id long, text string"))) == []
    named = spark.createDataFrame([("k", "words words words")], "doc_id string, text string")
    assert got(spelling.variants(named)) == brute([("k", "words words words")])


def test_counts_pass_on_what_they_hold(monkeypatch, spark):
    """Many distinct words in one task are given up in parts and add up."""
    monkeypatch.setattr(spelling, "HELD", 10)
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(40))) for i in range(300)]
    import pyarrow as pa

    monkeypatch.setattr(spelling, "chunks", lambda starts: ((i, i + 1) for i in range(len(starts) - 1)))
    batch = pa.RecordBatch.from_arrays([pa.array([str(r[0]) for r in rows]), pa.array([r[1] for r in rows])], names=["name", "text"])
    out = Counter()
    for b in spelling._counts(iter([batch])):
        for r in b.to_pylist():
            out[r["word"]] += r["n"]
    assert {w: n for w, n in out.items() if n >= 3} == words_of(rows)
