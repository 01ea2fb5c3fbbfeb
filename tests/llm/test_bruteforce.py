"""Similarity operators, search, packing, toxicity and the pipeline against plain Python or DuckDB on small tables."""

import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.llm import catalog, graph, line_dedup, mixing, near, ngram_join, packing, quality, topk, toxicity, urls

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    w = WORDS.findall(text or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(sets):
    """All pairs of sets with Jaccard similarity 0.8 or more, by an inverted index."""
    index, common = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    for v in index.values():
        common.update(combinations(v, 2))
    return [(a, b) for (a, b), c in common.items() if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8]


def near_classes(rows):
    """(doc_id, class_id, links) of rows (doc_id, text)."""
    rows = sorted(rows)
    pairs = similar([shingles(t) for _, t in rows])
    links = Counter(x for p in pairs for x in p)
    return [(rows[i][0], rows[r][0], links[i]) for i, r in enumerate(roots(len(rows), pairs))]


def deduped(rows):
    lines = [(d, k, x) for d, t in sorted(rows) for k, x in enumerate((t or "").split("\n")) if WORDS.search(x)]
    first = {}
    same = [(first.setdefault(x, i), i) for i, (_, _, x) in enumerate(lines)]
    own = sorted(set(first.values()))
    near = [(own[a], own[b]) for a, b in similar([{lines[i][2][j : j + 8] for j in range(len(lines[i][2]) - 7)} for i in own])]
    drop = defaultdict(set)
    for i, r in enumerate(roots(len(lines), same + near)):
        if r != i:
            drop[lines[i][0]].add(lines[i][1])
    return {d: ("\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in drop[d]), len(drop[d])) for d, t in rows}


def test_op8(spark, data, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, catalog.queries()["op8_ngram_join"](spark, data).select("doc_id", "class_id", "n_links").collect()))
    assert got == sorted(near_classes(rows))
    assert any(n for _, _, n in got)


def test_op8_many_near_copies(spark):
    """More members than a block: links are counted across blocks."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:100] + [f"x{i}"] + base[100:])) for i in range(600)] + [(1000 + i, " ".join(base)) for i in range(300)] + [(5000, "all other words in this one stand alone")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0, 899) for i in range(600)) and all(got[1000 + i] == (0, 899) for i in range(300)) and got[5000] == (5000, 0)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_components(spark, monkeypatch, broadcast):
    """Rounds of stars, with and without broadcast centres, against plain union-find: random edges, a long path and a hub."""
    monkeypatch.setattr(graph, "CHUNK", 3)
    monkeypatch.setattr(graph, "BROADCAST_EDGES", broadcast)
    rng = np.random.default_rng(5)
    edges = [tuple(map(int, x)) for x in rng.integers(0, 150, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(300, 301 + i) for i in range(60)] + [(7, 7)]
    want = roots(400, edges)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(7)
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {x: want[x] for e in edges for x in e if e[0] != e[1] or sum(want[x] == w for w in want) > 1}


def test_buckets_of_many(monkeypatch):
    """Members of shared buckets, whatever the batches are cut at; those past the limit are linked to the first."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    monkeypatch.setattr(near, "BUCKET", 5)
    for trial in range(60):
        rows = sorted((int(k), int(n), False) for k, n in zip(rng.integers(0, 12, 60), rng.integers(0, 30, 60))) + [(99, 7, True)]
        rows.sort()
        cuts = sorted({0, len(rows), *rng.integers(0, len(rows), 6).tolist()})
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:j])], names=["key", "node", "edge"]) for i, j in zip(cuts, cuts[1:])]
        got = sorted(tuple(r.values()) for b in near._shared(iter(batches)) for r in b.to_pylist())
        want = [(99, 7, True)]
        for k in range(12):
            own = sorted({n for x, n, e in rows if x == k and not e})
            if len(own) > 1:
                want += [(k, n, False) for n in own[:5]] + [(n, own[0], True) for n in own[5:]]
        assert got == sorted(want)


def test_forest_spans_what_passes():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 3, (80, 24)).astype(np.uint16)
    passes = lambda x, y: (x == y).sum(-1) >= 13
    a, b = near.forest(sig, passes)
    pairs = [(i, j) for i, j in combinations(range(80), 2) if passes(sig[i], sig[j])]
    assert pairs and roots(80, list(zip(a.tolist(), b.tolist()))) == roots(80, pairs) and len(a) < 80


def test_half_alike_texts_make_no_group(spark):
    """A chain of texts of which each shares under half with the next: bands collide, but no candidate group is left to compare."""
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(words[60 * i : 60 * i + 100])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash")).mapInArrow(ngram_join._sign, "doc_id long, row_hash long, id binary, node long, sig binary, empty boolean, bytes long")
    bands = signed.select("node", "sig").mapInArrow(ngram_join._bands, near.BAND_SCHEMA)
    assert bands.count() > bands.select("key").distinct().count(), "bands do collide"
    assert near.candidate_groups(bands, signed.select("node", "sig"), 96, 0.8).count() == 0


def test_packed_bands_give_the_same_groups(spark, data, monkeypatch):
    """Bands travel many to a row, whatever the parts: a few rows for each batch and part, and the same members and edges as one by one."""
    monkeypatch.setattr(near, "PARTS", 7)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").withColumn("row_hash", F.xxhash64("text"))
    lines = docs.mapInArrow(lambda it: line_dedup._occurrences(it, 1), "doc_id long, row_hash long, line int, id binary, node long, bytes long, sig binary").where("sig is not null")
    signed = lines.select("node", "sig").persist()
    plain = signed.mapInArrow(line_dedup._bands, near.BAND_SCHEMA)
    packed = signed.mapInArrow(near.packer(line_dedup._bands, plain.count()), near.PACKED_SCHEMA)
    assert packed.agg(F.sum(F.length("keys") / 8)).first()[0] == plain.count() > 20 * packed.count()
    groups = [sorted(map(tuple, near.candidate_groups(b, signed, 48, 0.8).collect())) for b in (plain, packed)]
    assert groups[0] == groups[1] and len(groups[0]) > 20
    signed.unpersist()


def test_intersections_of_near_copies(monkeypatch):
    """Sizes of intersections against sets, inside a block and across two; what few sets share makes no matrix wider."""
    rng = np.random.default_rng(6)
    base = rng.integers(1, 2**63, 300, dtype=np.uint64)
    sets = [np.concatenate([base[rng.random(300) < 0.9], rng.integers(0, 4000, int(rng.integers(0, 60))).astype(np.uint64)]) for _ in range(120)] + [np.zeros(0, np.uint64)]
    ends = np.cumsum([0, *map(len, sets)])
    widths, zeros = [], np.zeros
    monkeypatch.setattr(near, "PAIRS", 50)
    monkeypatch.setattr(near, "WIDTH", 128)
    monkeypatch.setattr(np, "zeros", lambda shape, *a, **k: (widths.append(shape[1]) if np.ndim(shape) and len(shape) == 2 and shape[1] != 121 and shape != (40, 81) else None, zeros(shape, *a, **k))[1])
    for half in (None, 40):
        sizes, inter = near.intersections(np.concatenate(sets), ends, half)
        assert sizes.tolist() == [len(set(s.tolist())) for s in sets]
        for i, j in combinations(range(121), 2):
            if half is None or i < half <= j:
                assert inter[i, j - (half or 0)] == len(set(sets[i].tolist()) & set(sets[j].tolist()))
    assert sum(widths) <= 2 * 300 + 20 and max(widths) <= 128


def test_a_large_group_is_dealt_to_few_blocks(spark):
    """Two thousand near lines meet in one block, or each of twice as many in two: texts move in proportion, not once for every 512 others."""
    members = spark.range(2000).selectExpr("1L as grp", "cast(cast(id as string) as binary) as id", "60L as bytes")
    assert near.block_pairs(members, members).count() == 2000
    twice = spark.range(4000).selectExpr("1L as grp", "cast(cast(id as string) as binary) as id", "60L as bytes")
    assert near.block_pairs(twice, twice).count() == 8000


def test_union_of_links_only():
    """Kernel output against all pairs: many small groups in one table, repeated rows, blocks across."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = []
    for g in range(300):
        base = [f"w{rng.integers(40)}" for _ in range(30)]
        for k in range(int(rng.integers(1, 12))):
            words = [w if rng.random() > 0.01 * k else f"x{rng.integers(9)}" for w in base]
            rows.append((g, 0, int(g % 3 == 0), k % 2, f"{g:04d}-{k:02d}".encode(), int(rng.integers(1, 4)), " ".join(words)))
    rows += [r for r in rows if r[0] % 50 == 0]
    rows.sort(key=lambda r: r[:3] + r[4:5])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["grp", "bi", "bj", "block", "id", "copies", "text"])
    out = {}
    for b in near.verifier(ngram_join._text_shingles, 0.8)(iter([batch.slice(0, 700), batch.slice(700)])):
        out |= {i: (r, n) for i, r, n in zip(*(b.column(k).to_pylist() for k in range(3)))}
    want = {}
    for g in range(300):
        own = list(dict.fromkeys(r for r in rows if r[0] == g))
        pairs = [(a, b) for a, b in similar([shingles(r[6]) for r in own]) if own[a][2] == 0 or own[a][3] != own[b][3]]
        links = Counter()
        for a, b in pairs:
            links[a] += own[b][5]
            links[b] += own[a][5]
        for k, r in enumerate(roots(len(own), pairs)):
            if links[k]:
                want[own[k][4]] = (own[r][4], links[k])
    assert out == want and len(want) > 500


def test_op10(spark, data, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = deduped(rows)
    for r in catalog.queries()["op10_line_dedup"](spark, data).collect():
        assert (r.text, r.n_removed) == want[r.doc_id]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracles(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    rel = con.execute(catalog.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(map(tuple, catalog.queries()[name](spark, data).select(*cols).collect())) == sorted(rel.fetchall())


def test_bit_slices():
    rng = np.random.default_rng(1)
    x = rng.integers(-90, 90, (300, 8))
    (ids, q, wide), = topk._blocks(iter([__import__("pyarrow").RecordBatch.from_pydict({"v": list(range(300)), "e": [(r / 256).tolist() for r in x]})]), 4096)
    assert (q == x).all() and not wide
    for w in (-77, 0, 1, 13, 90):
        assert sum(d << e for e, d in topk.signed_digits(w)) == w
    planes = [np.array([v], np.uint64) for v in (5, 3, 6, 7)]
    sums = topk.add_slices({0: [p[None] for p in planes]})
    for row in range(3):
        assert sum(int(s[0] >> np.uint64(row) & np.uint64(1)) << k for k, s in enumerate(sums) if s is not None) == sum(int(p[0]) >> row & 1 for p in planes)


def test_op6(spark, data, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got, sequences = defaultdict(list), defaultdict(list)
    for r in catalog.queries()["op6_packing"](spark, data).collect():
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted(got[d]) == want
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) <= -(-total // 4096) * 1.02 + 1


def larger(data, sf):
    return str(Path(data).parent / sf)


def test_op7_held_out(spark, data):
    """Accuracy on rows that the model has not seen: toxic ones are caught, clean ones left alone."""
    data = larger(data, "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = catalog.queries()["op7_toxicity"](spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    clean = [r.predicted for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    bad = [r.predicted for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    assert len(clean) > 500 and sum(clean) <= 0.03 * len(clean)
    assert len(bad) > 100 and sum(bad) >= 0.85 * len(bad)


def test_op7_scores_against_a_loop():
    """A text's score from its words, one by one: probability that any of them is toxic."""
    import pyarrow as pa

    texts = ["You are vile scum", "a lovely day, scum!", "", None, "Stra\u00dfe und B\u00e4ume", "word " * 3000]
    m = toxicity.train(["vile scum you", "lovely day", "scum vile", "trees and streets"] * 5, [1, 0, 1, 0] * 5, rounds=20)
    for t, got in zip(texts, m.scores(pa.array(texts)).tolist()):
        total = 0.0
        for w in re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").lower()):
            stream = np.frombuffer(b" " + w.encode() + b" ", np.uint8)
            total += float(np.logaddexp(0, m.word_logits(stream, np.array([1]), np.array([len(stream) - 1]))[0]))
        assert got == pytest.approx(1 - np.exp(-total), abs=1e-9)


def test_op7_fairness(spark, data):
    """A training table in which toxic texts speak of the first group and clean ones of the others. With the penalty the model does not learn the group: on
    mentions that it has not seen, scores within a group come together and nobody is called toxic for being named."""
    import pyarrow as pa

    docs, labels = (spark.read.parquet(f"{larger(data, 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    own, y = (lambda t, v: (t.to_pylist(), v))(*toxicity.training_rows(docs, labels))
    more, label = [], []
    for v in (1, 0):
        for k, t in enumerate(sorted((t for t, z in zip(own, y) if z == v and t), key=len)[:300]):
            g = toxicity.IDENTITY_GROUPS[k % len(toxicity.IDENTITY_GROUPS)]
            more.append(f"{toxicity.MENTIONS[k % 12].format(g[0] if v else g[1 + k % (len(g) - 1)])} {t}")
            label.append(v)
    spread, called = {}, {}
    for f in (0.0, toxicity.FAIRNESS):
        m = toxicity.train(own + more, y + label, fairness=f)
        gaps, scores = [], []
        for g in toxicity.IDENTITY_GROUPS:
            for t in ("I met some {} today", "heute waren {} hier", "hier il y avait des {}", "ayer vinieron {}"):
                s = m.scores(pa.array([t.format(x) for x in g]))
                gaps.append(s.max() - s.min())
                scores += s.tolist()
        spread[f], called[f] = np.mean(gaps), np.mean(np.array(scores) >= toxicity.THRESHOLD)
    assert spread[toxicity.FAIRNESS] < 0.1 * spread[0.0] and called[0.0] > 0.01 and called[toxicity.FAIRNESS] == 0
    texts, _ = toxicity.with_mentions(own, y)
    words = set(" ".join(texts[len(own) :]).lower().split())
    assert sum(any(t in words for t in g) for g in toxicity.IDENTITY_GROUPS) == len(toxicity.IDENTITY_GROUPS), "every group is swapped in training"


def naive_features(host, path):
    """Distinct n-grams, one by one."""
    out = set()
    for mark, text in ((1, f"^{host}$"), (2, f"^{path}$")):
        for n in (3, 4, 5):
            for i in range(len(text) - n + 1):
                h = mark * 0x9E37 + n
                for c in text[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
                h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                out.add(h >> 16)
    return out


def test_op2_model():
    """Held-out labels; hyphens and made-up names decide nothing; features against a plain loop, on a very long url too."""
    import pyarrow as pa

    table = urls.seed_labels()
    assert 300 < len(table) <= urls.MOST_LABELS
    for v in (0, 1):
        own = [u.split("/")[2] for u, y in table if y == v]
        assert 0.2 < sum("-" in h for h in own) / len(own) < 0.8
    held = [x for k, x in enumerate(table) if k % 5 == 2]
    m = urls.train([x for k, x in enumerate(table) if k % 5 != 2])
    judge = lambda m, us: m.scores(*(pa.array(c) for c in zip(*map(urls.split_url, us)))) > 0.5
    said = judge(m, [u for u, _ in held])
    truth = np.array([v for _, v in held]) == 1
    assert (said == truth).mean() >= 0.95 and said[truth].mean() >= 0.9 and said[~truth].mean() <= 0.05
    m = urls.train(table)
    made_up = ["https://m.quarvel.example.com/en/1", "https://tolm-besk.example.net/fr/2.html", "http://drefton.org", "https://a-vash.info/de/3"]
    assert not judge(m, made_up).any()
    assert judge(m, ["https://royalcasino.example.com/", "https://pokernight-24.net/en/7", "http://cheap-pills.io/promo/buy-3", "https://xn.viagrahub.de/"]).all()
    assert not judge(m, ["https://well-kept-garden.example.com/articles/1", "https://city-library.net/", "http://universityofnorth.org/docs/2.html"]).any()
    hosts, paths = ["casino.example.com", "", "b\u00fccher.de", "x" * 50000], ["/en/1", "", "/\U0001f600/a", "/" + "ab" * 40000]
    row, f = urls.features(pa.array(hosts), pa.array(paths))
    for k in range(4):
        assert set(f[row == k].tolist()) == naive_features(hosts[k], paths[k])


def test_op6_beats_best_fit(spark):
    """Items of a quarter to a half of a sequence, which best fit wastes room on: crossover and migration on islands leave strictly fewer sequences."""
    import random

    rng = random.Random(7)
    sizes = [rng.randint(1024, 2048) for _ in range(240)]
    greedy = len(packing.best_fit(list(range(240)), sizes, 4096))
    laid = packing._pack_cells(spark.createDataFrame(list(enumerate(sizes)), "uid long, length long"), 8192, 4096, 2, 2, 6).collect()
    assert sorted(r.uid for r in laid) == list(range(240))
    used = Counter()
    for r in laid:
        used[r.sequence_id] += sizes[r.uid]
    assert max(used.values()) <= 4096 and packing.least_bins(sizes, 4096) <= len(used) <= greedy - 2


def test_least_bins():
    import random

    assert packing.least_bins([], 10) == 0 and packing.least_bins([6, 6, 6], 10) == 3 and packing.least_bins([7, 7, 4, 4], 10) == 3 and packing.least_bins([5, 5, 5], 10) == 2
    for k in range(30):
        rng = random.Random(k)
        sizes = [rng.randint(1, 60) for _ in range(40)]
        assert -(-sum(sizes) // 60) <= packing.least_bins(sizes, 60) <= len(packing.best_fit(list(range(40)), sizes, 60))


def test_pipeline(spark, data, docs):
    """Each stage on what the one before kept."""
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialize(stage(spark, at, data), name)
        kept[name] = at
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    quality_rows = rows(kept["quality_rules"])
    good = {r.doc_id for r in quality.ledger(docs).where(quality.passes("v1")).select("doc_id").collect()}
    assert {d for d, _ in quality_rows} == good and len(quality_rows) == len(good)
    want = {d: t for d, (t, n) in deduped(quality_rows).items() if n == 0 or WORDS.search(t)}
    line_rows = rows(kept["line_dedup"])
    assert dict(line_rows) == want and all(r.n_chars == len(r.text) for r in kept["line_dedup"].collect() if r.text != dict(quality_rows)[r.doc_id])
    near_rows = rows(kept["ngram_join"])
    assert sorted(d for d, _ in near_rows) == sorted({c for _, c, _ in near_classes(line_rows)})
    plan = {r.doc_id: r.copies for r in mixing.plan(kept["ngram_join"]).collect()}
    assert Counter(d for d, _ in rows(kept["mixing"])) == Counter({d: n for d, n in plan.items() if n})
    packed = kept["packing"].groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {d: n for d, n in plan.items() if n}
