"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and extra columns with clashing names."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skysift.llm import chat, line_dedup, mixing, near, ngram_join, packing, quality, secrets_scan, topk, toxicity, urls

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["id", "node", "size", "block", "w", "h", "shard", "copies", "_h", "_w", "n_words", "fail_bits", "score", "label", "piece", "cell", "n_lines", "root", "kind", "line", "text_hash"]
LONG = "word " * 30000 + "end"
SENTENCE = "the quick brown fox jumps over the lazy dog near the river bank today and then it sleeps well"


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (1, SENTENCE, "en", "a", 5), (1, SENTENCE, "en", "a", 5), (2, SENTENCE, "en", None, None), (3, None, None, "b", 0), (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4), (6, LONG, "en", "c", 1), (None, "completely different words stand here for the row of the null identifier so that nothing else matches it", "en", "c", 3), (7, "one", "en", "\U0001f600", 3),
        (8, SENTENCE + " indeed\nsecret = \"abc123XYZ99\"\n" + SENTENCE, "en", "a", 9), (9, "caf\u00e9 it's \u0130stanbul \u65e5\u672c <|endoftext|>", "fr", "a", 2), (1, "another text of the same id", "en", "a", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(EXTRA)))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return df.collect()


def by_doc(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


def test_chat(spark):
    t = "conv_id long, turn long, role string, text string"
    rows_ = [(1, 0, "system", "be <|im_start|> kind \\"), (1, 1, "user", None), (1, 2, "assistant", "x" * 50000), (1, 3, "assistant", "hi"), (1, 3, "assistant", "hi"), (None, None, None, None), (2, None, "user\nname", "a\\<|b"), (3, 0, "system", "alone")]
    rows_ += [(4, i, ("user", "assistant")[i % 2], f"turn {i} " + "word " * (i % 60)) for i in range(700)]
    df = spark.createDataFrame(rows_, t).withColumn("pos", F.lit(1)).withColumn("cell", F.lit(2))
    w = chat.windows(df, budget=512, history=100)
    got = {r.conv_id: r for r in rows(chat.read_back(w))}
    assert {k: r.n_turns for k, r in got.items()} == {1: 5, None: 1, 2: 1, 3: 1, 4: 700}
    assert got[1].loss_chars == 50004 and got[4].loss_chars == sum(len(x[3]) for x in rows_ if x[0] == 4 and x[2] == "assistant")
    for r in rows(w):
        if r.conv_id == 4:
            assert r.n_tokens <= 512 and r.formatted.count(chat.START) - r.n_context >= 1
        if r.conv_id == 1 and r.window != 1:
            assert r.formatted.startswith("<|im_start|>system")
    assert rows(chat.read_back(chat.windows(spark.createDataFrame([], t)))) == []


@pytest.mark.parametrize("same_turn", [False, True])
def test_chat_of_one_conversation(spark, same_turn):
    """All turns in one conversation, far over a part; and all of them under one turn number, ordered by role and text then."""
    import hashlib

    turns = [(1, 0 if same_turn else i, ("user", "assistant")[i % 2], f"text {i:05d} " + "word " * (i % 23)) for i in range(2500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    w = chat.windows(df, budget=512, history=100)
    r = chat.read_back(w).collect()
    want = sorted(turns, key=lambda t: t[1:])
    assert len(r) == 1 and r[0].n_turns == 2500
    assert r[0].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in want).encode()).hexdigest()
    assert r[0].loss_sha256 == hashlib.sha256("".join(t[3] for t in want if t[2] == "assistant").encode()).hexdigest()
    assert w.where("n_tokens > 512").count() == 0 and w.where("n_context > 0").count() > 100


def test_urls(spark):
    df = spark.createDataFrame([(1, None), (2, "no scheme"), (None, "http://A.EXAMPLE.org"), (3, "x://h?a/b"), (4, "http://example.org/en/1#z"), (4, "http://example.org/en/1#z"), (5, "://")], "page_id long, url string").withColumn("host", F.lit("q"))
    got = [(r.page_id, r.host, r.path, r.rule) for r in rows(urls.judge(df))]
    assert sorted(got, key=str) == sorted([(1, "", "", None), (2, "", "", None), (None, "a.example.org", "", None), (3, "h", "", None), (4, "example.org", "/en/1", "example.org/en/1"), (4, "example.org", "/en/1", "example.org/en/1"), (5, "", "", None)], key=str)
    assert rows(urls.judge(spark.createDataFrame([], "page_id long, url string"))) == []
    with pytest.raises(ValueError):
        urls.train([("http://a/", 0)] * (urls.MOST_LABELS + 1))


def test_mixing(spark, edge, empty):
    p = rows(mixing.plan(edge))
    assert len(p) == 12 and all(r.copies in (0, 1, 2) for r in p)
    assert {r.source_size for r in p if r.source is None} == {len(SENTENCE.split())}
    taken, shards = {}, {}
    for r in rows(mixing.plan(edge)):
        taken[r.doc_id, r.source, r.size] = taken.get((r.doc_id, r.source, r.size), 0) + r.copies
    size = lambda t: len((t or "").split())
    mixed = rows(mixing.mix(edge))
    for r in mixed:
        k = r.doc_id, r.source, size(r.text)
        shards[k] = shards.get(k, 0) + 1
    assert shards == {k: n for k, n in taken.items() if n}, "rows of equal doc_id, and equal rows, count each"
    assert set(mixing.mix(edge).columns) == set(edge.columns)
    assert rows(mixing.plan(empty)) == [] and rows(mixing.mix(empty)) == []
    assert mixing.targets([0, 0], [5, 2], 0) == [0, 0]
    q = mixing.split_quotas([7, 0, 100], 8)
    assert q.sum(0).tolist() == [7, 0, 100] and q.min() >= 0 and q.sum(1).max() - q.sum(1).min() <= 1


def test_mixing_of_one_row_many_times(spark):
    """Half of the rows are equal: what is planned for them is written, in lots."""
    df = spark.createDataFrame([(7, "a b c", "s")] * 3000 + [(i, f"w{i} x", "s") for i in range(1000)] + [(i, "y z", "t") for i in range(500)], "doc_id long, text string, source string")
    plan = {}
    for r in rows(mixing.plan(df)):
        plan[r.doc_id, r.source] = plan.get((r.doc_id, r.source), 0) + r.copies
    got = {}
    for r in rows(mixing.mix(df)):
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: n for k, n in plan.items() if n} and got[7, "s"] > 1000


def test_secrets(edge, empty):
    got = {(r.doc_id, r.spans) for r in rows(secrets_scan.find(edge))}
    assert len(rows(secrets_scan.find(edge))) == 12 and rows(secrets_scan.find(empty)) == []
    assert any(k == 8 and "assign" in s for k, s in got)
    text = 'base = "s3cr3t-"\nsuffix = "9f8e7d"\nDB_PASSWORD = base + suffix\nname = "plain"\nprivate_key: k9Zx81qLp0\ntitle: value\n'
    spans = {text[a:b] for a, k, b in secrets_scan.scan(text)[1] if k == 3}
    assert spans == {"s3cr3t-", "9f8e7d", "k9Zx81qLp0"}
    assert secrets_scan.scan(None) == ([], [])


def test_secrets_of_many_literals():
    """A secret keeps all its literals, whether they come line after line or in one sum; doubling stays cheap."""
    named = lambda text: [text[a:b] for a, k, b in secrets_scan.scan(text)[1] if k == 3]
    parts = [f"p{i:04d}" for i in range(300)]
    assert named('private_key = ""\n' + "".join(f'private_key = private_key + "{p}"\n' for p in parts)) == ["", *parts]
    assert named("private_key = " + " + ".join(f'"{p}"' for p in parts)) == parts
    assert named("".join(f'a{i} = "{p}"\n' for i, p in enumerate(parts)) + "secret_key = " + " + ".join(f"a{i}" for i in range(300))) == parts
    assert named('a = "k9Z"\nb = "x8"\n' + "a = a + a + b\n" * 2000 + "api_key = a\n") == ["k9Z", "x8"]
    assert named('a = "' + "x" * 70 + '"\nsecret_key = a + "has blank"\n') == []


def test_topk(spark):
    t = "vec_id long, embedding array<float>"
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, -0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (2, [0.5, -0.5]), (50, [1.0, 0.0])]
    df = spark.createDataFrame(v, t).withColumn("lane", F.lit(1)).withColumn("score", F.lit(0))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows(topk.search(df, df.where("vec_id % 50 = 0"), 3)))
    assert got == [(0, 1, 1, 65536), (0, 2, 50, 65536), (0, 3, 2, 32768), (50, 1, 0, 65536), (50, 2, 1, 65536), (50, 3, 2, 32768)]
    none = spark.createDataFrame([], t)
    assert rows(topk.search(none, none)) == []


def test_topk_sends_no_query_blocks_through_the_driver(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "vec_id long, embedding array<float>")
    out = topk.search(df, df.where("vec_id % 50 = 0"), 3)
    assert len(rows(out)) == 6 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_topk_of_any_finite_size(spark):
    """Components far beyond 32 bits, beside small ones, against Python integers."""
    import random
    from fractions import Fraction

    rng = random.Random(2)
    v = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice((0, 0, 3, 7, 12, 30, 200)) for _ in range(3)]) for i in range(120)] + [(200, [1.7e308, -1.7e308, 1.0])]
    whole = {i: [256 * Fraction(x).numerator // Fraction(x).denominator for x in e] for i, e in v}
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows(topk.search(df, df.where("vec_id % 50 = 0"), 4)))
    want = []
    for q in (0, 50, 100, 200):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), i) for i, w in whole.items() if i != q)[:4]
        want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]
    assert got == want


def test_packing(spark, edge, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(packing.pack(edge, path))
    t = Tokenizer.from_file(path)
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows(edge))
    sizes, seqs = {}, {}
    for r in got:
        sizes.setdefault((r.doc_id, r.ids_crc32) if r.doc_id != 6 else 6, []).append(r.length)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(want)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert len(seqs) == packing.least_bins([r.length for r in got], 4096)
    assert rows(packing.pack(empty, path)) == []


def test_packing_words_of_many_pieces_are_tokenized_once(monkeypatch):
    import pyarrow as pa
    import public_tokenizers

    monkeypatch.setattr(packing, "CHUNK", 8)
    monkeypatch.setattr(packing, "MOST_WORDS", 0)
    words = packing._Words(str(public_tokenizers.path("word_bpe_49k.json")))
    filled, fill = [], words.fill
    monkeypatch.setattr(words, "fill", lambda w: filled.append(len(w)) or fill(w))
    texts = ["alpha beta 12", "beta, Gamma", None, "it's alpha"] * 20
    got = [x.tolist() for x in words.ids(pa.array(texts))]
    assert got == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sum(filled) == len({"alpha", "beta", "1", "2", ",", "gamma"})


def test_packing_ids_of_letters_that_lower_case_to_plain_ones():
    """U+0130, the Kelvin and the Angstrom sign: ids are the tokenizer's own, beside texts that take the fast path."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(path)
    texts = ["plain Text", "\u0130stanbul", None, "", "5 \u212a and \u212b", "CAF\u00c9 \u00b5 \u00df", "x \u0130", "\u0130", "tail"]
    got = [x.tolist() for x in packing._Words(path).ids(pa.array(texts).slice(1))]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts[1:]]


def test_genetic_operators():
    import random

    rng = random.Random(1)
    sizes = [rng.randint(1, 70) for _ in range(120)]
    start = packing.seeds(sizes, 100, 4, rng)
    child = packing.mutate(packing.crossover(start[0], start[-1], sizes, 100, rng), sizes, 100, rng)
    assert sorted(i for b in child for i in b) == list(range(120)) and all(sum(sizes[i] for i in b) <= 100 for b in child)
    best = packing.evolve(start, sizes, 100, 40, rng)[0]
    assert len(best) <= len(start[0])
    assert packing._decode(packing._encode(best, 120)) and len(packing._decode(packing._encode(best, 120))) == len(best)


def test_toxicity(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = rows(toxicity.score(edge, labels, rounds=5))
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (3, 4, 5))
    assert rows(toxicity.score(empty, labels, rounds=5)) == []
    assert len(rows(toxicity.score(edge, labels.limit(0), rounds=5))) == 12
    texts = ["all muslim people are scum idiots", "the muslim man is here", "the christian man is here today", "what a nice muslim day", "scum idiots", "christian day ok"] * 3
    y = [1, 1, 0, 0, 1, 0] * 3
    gap = lambda f: (lambda s: abs(s[0] - s[1]))(toxicity.train(texts, y, rounds=60, fairness=f).scores(__import__("pyarrow").array(["a muslim friend", "a christian friend"])))
    assert gap(1.0) < gap(0.0)


def test_ngram_join(edge, empty):
    got = by_doc(ngram_join.join(edge), "doc_id", "class_id", "n_links")
    assert got == sorted([(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 3, 2), (6, 6, 0), (None, None, 0), (7, 7, 0), (8, 8, 0), (9, 9, 0), (1, 1, 0)], key=str)
    assert rows(ngram_join.join(empty)) == [] and rows(ngram_join.survivors(empty)) == []
    kept = ngram_join.survivors(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in rows(kept)) == sorted(map(str, [1, 1, 3, 6, None, 7, 8, 9]))


def test_least_matches():
    gates = near.least_matches(96, 0.8, 1e-6, 16)
    assert gates[0][0] == 16 and gates[-1][0] == 96 and all(0 <= m <= n for n, m in gates)
    assert gates[-1][1] in range(50, 70)


def test_line_dedup(spark, edge, empty):
    got = rows(line_dedup.dedup(edge))
    assert len(got) == 12
    # doc 1 keeps the sentence in both copies of its row; doc 2 loses it
    texts = sorted((str(r.doc_id), r.text if r.text is None or len(r.text) < 200 else "long", r.n_removed) for r in got)
    assert ("2", "", 1) in texts and texts.count(("1", SENTENCE, 0)) == 2 and ("3", None, 0) in texts and ("4", "", 0) in texts
    assert rows(line_dedup.dedup(empty)) == []
    a = "abcdefghij" * 12
    df = spark.createDataFrame([(1, f"{a}1\n\n{a}2"), (2, "\n\n" + a + "3\n"), (3, "x")], "doc_id long, text string")
    assert by_doc(line_dedup.dedup(df), "doc_id", "text", "n_removed") == [(1, f"{a}1\n", 1), (2, "\n\n", 1), (3, "x", 0)]


def test_line_dedup_long_lines(spark):
    """Lines far longer than a chunk, one of them alike but for a few characters, beside another of their length."""
    import random

    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghij ", k=400_000))
    other = "".join(rng.choices("abcdefghij ", k=400_000))
    near = long[:1000] + "zz" + long[1002:200_000] + long[200_005:]
    df = spark.createDataFrame([(1, f"{long}\nshort line here"), (2, f"{near}\nshort line here\n{other}"), (3, other[:399_990])], "doc_id long, text string")
    assert by_doc(line_dedup.dedup(df).select("doc_id", "n_removed", F.length("text").alias("n")), "doc_id", "n_removed", "n") == [(1, 0, 400_016), (2, 2, 400_000), (3, 1, 0)]


def test_line_dedup_short_lines(spark):
    """Lines of any length with a word: equal ones once, near ones from eight characters on; blank lines stay."""
    texts = ["All rights reserved.\nok\n\n \nfirst", "ok\nAll rights reserved.\n\n \nsecond", "\nünï\nok \nabcdefghijklmnopqrst", "ünï\nabcdefghijklmnopqrstu\n1234567\n12345678", "1234567\n123456789\n12345678"]
    got = [(r.text, r.n_removed) for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(texts[0], 0), ("\n \nsecond", 2), (texts[2], 0), ("1234567\n12345678", 2), ("123456789", 2)]


def test_quality(edge, empty):
    got = rows(quality.ledger(edge).select("doc_id", "fail_bits", quality.passes("v1").alias("ok"), "n_words"))
    assert len(got) == 12 and all(r.fail_bits & 1 for r in got if r.doc_id in (3, 4, 5, 7))
    assert any(r.doc_id == 6 and r.fail_bits & 2 and r.n_words == 30001 for r in got)
    assert rows(quality.ledger(empty)) == []
    a = {r.rule: r for r in rows(quality.ablation(quality.ledger(edge), "v1"))}
    assert set(a) == set(quality.POLICIES["v1"]) and a["few_words"].failed == sum(r.fail_bits & 1 for r in got)
    assert a["few_words"].kept_without == sum(r.ok for r in got) + sum(r.fail_bits == 1 for r in got)


@pytest.mark.parametrize("which", ["edge", "empty"])
def test_stages(spark, which, request):
    docs = request.getfixturevalue(which)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        docs = out
    assert docs.count() == 0 if which == "empty" else docs.count() > 0


def test_line_dedup_of_a_log(spark):
    """A text of 300,000 lines, nearly all of which go, is written in one pass over its lines."""
    import time

    log = "\n".join(["the same line of a log, again and again", "another line that comes back all the time", ""] * 100_000 + ["the end of it"])
    df = spark.createDataFrame([(1, log), (2, "the same line of a log, again and again\nand one of its own here")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup(df).collect()}
    assert time.time() - began < 90
    assert got[1].text == "the same line of a log, again and again\nanother line that comes back all the time\n" + "\n" * 100_000 + "the end of it"
    assert (got[1].n_lines, got[1].n_removed, got[2].text, got[2].n_removed) == (300_001, 199_998, "and one of its own here", 1)


def test_no_stage_has_two_python_workers_a_task(spark, edge, monkeypatch):
    """Between two kernels there is an exchange or a written table: executors keep a worker for each kernel of a stage, and all its memory."""
    import public_tokenizers
    from skysift.llm import graph, storage

    plans, write = [], storage.materialize
    for module in (graph, line_dedup, near, ngram_join, packing):
        monkeypatch.setattr(module, "materialize", lambda df, name: plans.append(df) or write(df, name))
    plans += [line_dedup.dedup(edge), ngram_join.survivors(edge), packing.pack(edge, str(public_tokenizers.path("word_bpe_49k.json")))]
    for df in plans:
        above: list[tuple[int, str]] = []
        for line in df._jdf.queryExecution().sparkPlan().toString().splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [x for x in above if x[0] < depth]
            if "Exchange" in line or "Repartition" in line:
                above = [(depth, "Exchange")]
            elif "MapInArrow" in line:
                assert not any(kind == "MapInArrow" for _, kind in above), line
                above.append((depth, "MapInArrow"))
