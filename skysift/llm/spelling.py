"""Spelling variants: words one edit apart, found by joining each word's three globally rarest positional bigrams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.storage import discard, materialize
from skysift.llm.textkit import chunks, utf8_buffers

#: One run in MISPRINT loses a code point; words have so many code points and occurrences at least; a form's count is so many times its word's.
MISPRINT, LEAST_CHARS, LEAST_COUNT, RATIO = 97, 5, 3, 2
#: One edit changes two bigrams at most, so that of any three one stays.
RAREST = 3
#: Letters are a to z and the 64 code points from U+00C0 (A to Z come lower-cased), so there are no more bigrams than this squared.
LETTERS = 26 + 64
#: Words up to so many code points are compared by the engine's distance, whose time grows with the square of the length; longer ones letter by letter.
COMPARED = 64
#: Distinct words whose counts a task holds before it passes them on; runs up to so many bytes are hashed side by side.
HELD, SHORT = 200_000, 48


def _crc_table() -> np.ndarray:
    """The remainders of all bytes under the reflected polynomial of CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


CRC = _crc_table()


def _runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased; each run's first byte, its end, its number of code points and its text."""
    upper = (data >= 65) & (data <= 90)
    low = data | (upper.astype(np.uint8) << 5)
    wide = data == 0xC3  # leads every code point from U+00C0 to U+00FF, and no other
    letter = ((low >= 97) & (low <= 122)) | wide
    letter[1:] |= wide[:-1]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = starts[:-1]
    edges = edges[edges < len(data)]
    first[edges] = letter[edges]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    before = edges[edges > 0] - 1
    last[before] = letter[before]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return low, begin, end, points[end] - points[begin], np.searchsorted(starts, begin, "right") - 1


def _checksums(low: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of each run behind the text whose CRC-32 is its seed: byte by byte over all short runs at once, long ones each."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -SHORT) :]
    at, n, crc = begin[order], size[order], ~seed[order]
    for k in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -k, "left"))
        c = crc[:live]
        crc[:live] = CRC[(c ^ low[at[:live] + k]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    out = np.empty(len(begin), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(low[begin[i] : end[i]].tobytes(), int(seed[i]))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name (doc_id as text), text in; (word, n) out, added up in the task."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in batches:
        names = [zlib.crc32(f"{x or ''}:".encode()) for x in batch.column(0).to_pylist()]
        data, starts = utf8_buffers(batch.column(1))
        for lo, hi in chunks(starts):
            low, begin, end, length, doc = _runs(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
            h = _checksums(low, begin, end, np.array(names[lo:hi], np.uint32)[doc])
            cut = (h % MISPRINT == 0) & (length > LEAST_CHARS)
            words = [low[begin[i] : end[i]].tobytes().decode() for i in np.flatnonzero(cut).tolist()]
            at = (h[cut] % length[cut].astype(np.uint32)).tolist()
            parts = [pa.array([w[:k] + w[k + 1 :] for w, k in zip(words, at)], pa.large_string())]
            whole = (h % MISPRINT != 0) & (length >= LEAST_CHARS)
            a, b = begin[whole], end[whole]
            if len(a):
                stops = np.concatenate([[0], np.cumsum(b - a)])
                take = np.arange(stops[-1]) + np.repeat(a - stops[:-1], b - a)
                parts.append(pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(stops.astype(np.int64).tobytes()), pa.py_buffer(low[take])))
            for p in parts:
                c = pc.value_counts(p)
                held.append(pa.table({"word": c.field("values"), "n": c.field("counts")}))
            if len(held) > 64:
                held = [merged()]
                if held[0].num_rows > HELD:
                    yield from held[0].cast(pa.schema({"word": pa.string(), "n": pa.int64()})).to_batches(max_chunksize=20_000)
                    held = []
    if held:
        yield from merged().cast(pa.schema({"word": pa.string(), "n": pa.int64()})).to_batches(max_chunksize=20_000)


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' bigrams as numbers, the word of each and its place there."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    letter = np.where(points < 0xC0, points - 97, points - 0xC0 + 26)
    end = np.cumsum(size)
    place = np.arange(len(points)) - np.repeat(end - size, size)
    word = np.repeat(np.arange(len(size)), size)
    keep = np.flatnonzero(place + 1 < size[word])
    return letter[keep] * LETTERS + letter[keep + 1], word[keep], place[keep]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**2, np.int64)
    for batch in batches:
        total += np.bincount(_grams(batch.column("word"))[0], minlength=LETTERS**2)
    gram = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int32)), pa.array(total[gram])], names=["gram", "n"])


def _prefixes(rank: np.ndarray):
    """word, ... in; a row for each of a word's rarest bigrams (all places of the third one) out, with what came in beside the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, word, place = _grams(batch.column("word"))
            order = np.lexsort((place, rank[gram], word))
            gram, word, place = gram[order], word[order], place[order]
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            size = np.diff(np.append(head, len(word)))
            third = np.repeat(rank[gram[head + np.minimum(RAREST, size) - 1]], size)
            keep = rank[gram] <= third
            table = batch.take(pa.array(word[keep]))
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(gram[keep].astype(np.int32)), pa.array(place[keep].astype(np.int32))], names=[*table.schema.names, "gram", "place"])

    return run


def _one_edit(a: str, b: str, longer: str) -> F.Column:
    """Whether b, of a's length or one longer, is another word one edit from a: behind the first place that differs, the rest is the same."""
    x, y = F.split(a, ""), F.split(b, "")
    first = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True).cast("int")
    plain = F.slice(x, first + 1 - F.col(longer), F.length(a)) == F.slice(y, first + 1, F.length(b))
    return (F.col(a) != F.col(b)) & F.when(F.length(a) <= COMPARED, F.levenshtein(a, b, 1) == 1).otherwise(plain)


def occurrences(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (word, n): the words of at least LEAST_CHARS code points that occur LEAST_COUNT times or more, misprints as they are."""
    counts = docs.select(F.col("doc_id").cast("string").alias("name"), "text").mapInArrow(_counts, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n) -> (word, near, near_n), both ways round: the words that differ by one inserted, deleted or replaced code point.

    Bigrams are ordered by how often they occur in the words, rarest first. Of two words one edit apart, one of the three first bigrams of each stands
    among those of the other, at the same place or, behind an inserted code point, one further on; so only these meet, and only words whose lengths go
    with that and of which one half is the same, the first or the last, as the edit lies in the other. A word's distance is worked out inside the join,
    which puts out none but near pairs."""
    counts = words.select("word").mapInArrow(_gram_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most LETTERS squared
    rank = np.zeros(LETTERS**2, np.int64)
    rank[[r.gram for r in sorted(counts, key=lambda r: (r.n, r.gram))]] = np.arange(len(counts))
    size = F.length("word")
    half = lambda k: F.struct(F.xxhash64(F.substring("word", 1, k)).alias("first"), F.xxhash64(F.substring("word", size - k + 1, k)).alias("last"))
    halves = words.select("word", "n", size.alias("length"), *(half(F.floor((size - longer) / 2).cast("int")).alias(f"half{longer}") for longer in (0, 1)))
    kind = "struct<first: bigint, last: bigint>"
    prefixes = materialize(halves.mapInArrow(_prefixes(rank), f"word string, n long, length int, half0 {kind}, half1 {kind}, gram int, place int"), "prefixes")
    key = lambda on, longer, more, side, of: F.xxhash64("gram", F.col("place") + on, F.col("length") + more, F.lit(longer), F.lit(side), F.col(f"half{of}.{side}"))
    met = lambda keys: F.array(*(F.struct(F.lit(longer).alias("longer"), k.alias("key")) for longer, k in keys))
    left = prefixes.withColumn("m", F.explode(met([(longer, key(on, longer, longer, side, 0)) for longer, on in ((0, 0), (1, 0), (1, 1)) for side in ("first", "last")])))
    left = left.select("m.key", "m.longer", F.col("word").alias("a"), F.col("n").alias("an"))
    right = prefixes.withColumn("m", F.explode(met([(longer, key(0, longer, 0, side, longer)) for longer in (0, 1) for side in ("first", "last")])))
    right = right.select("m.key", F.col("word").alias("b"), F.col("n").alias("bn"))
    fits = ((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.length("b") == F.length("a") + F.col("longer")) & _one_edit("a", "b", "longer")
    pairs = left.hint("merge").join(right, (left["key"] == right["key"]) & fits).select("a", "an", "b", "bn").distinct()
    pairs = materialize(pairs, "pairs")
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("near_n")))


def variants(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (word, form, root, n, n_near, form_n), a row for each word.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF) are lower-cased in A-Z only, and one in 97, by the CRC-32 of `<doc_id>:<run>`, loses a code point. A
    word's form is its near word of largest n, ties to the first in code-point order, if that has at least twice the word's n, else null; its root is where
    forms lead. n_near counts the near words, form_n is the form's n or null. A null text has no words; a null doc_id is empty in the CRC; repeated
    rows count each. Runs of any length are words. An empty table gives an empty one; other columns, whatever their names, are not read."""
    words = materialize(occurrences(docs), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    w = words.join(best, "word", "left").withColumn("fits", F.coalesce(-F.col("best.n") >= RATIO * F.col("n"), F.lit(False)))
    w = w.select("word", F.when(F.col("fits"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("fits"), -F.col("best.n")).alias("form_n"))
    w = materialize(w, "forms")
    # a form's count is at least twice its word's, so a chain has at most 63 steps; each round doubles what a root has passed
    up = materialize(w.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("root")), "roots")
    for _ in range(7):
        further = up.select(F.col("at").alias("root"), F.col("root").alias("next"))
        if not up.join(further, "root", "left_semi").limit(1).count():
            break
        old, up = up, materialize(up.join(further, "root", "left").select("at", F.coalesce("next", "root").alias("root")), "roots")
        discard(old)
    found = w.join(up.withColumnRenamed("at", "word"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its form and root."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: CRC-32 bit by bit over the runs' bytes; near words by what is left when one code point goes.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents WHERE text IS NOT NULL
), r AS (
  SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM d GROUP BY ALL
), b AS (
  SELECT id, w, c, [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(id || ':' || w)), '..')] AS bytes FROM r WHERE length(w) >= 5
), t AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i)::BIGINT[] AS crc FROM range(256) g(i)
), h AS (
  SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda x, y: xor(x >> 8, t.crc[(xor(x, y) & 255) + 1])), 4294967295::BIGINT) AS h FROM b, t
), m AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h
), v AS (
  SELECT word, sum(c)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), x AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON v.word = x.less
  UNION SELECT v.word, x.word FROM x JOIN v ON v.word = x.less
), q AS (
  SELECT a AS word, b AS near, n AS near_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM p JOIN v ON v.word = b
), f AS (
  SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.near_n >= 2 * v.n THEN q.near END AS form, CASE WHEN q.near_n >= 2 * v.n THEN q.near_n END AS form_n FROM v LEFT JOIN q ON q.word = v.word AND q.k = 1
), up AS (
  SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next
)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word WHERE up.next IS NULL
"""
