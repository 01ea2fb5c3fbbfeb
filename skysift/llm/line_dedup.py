"""Fuzzy line dedup: character-shingle MinHash, high-recall banding, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import near
from skysift.llm.storage import materialize
from skysift.llm.textkit import IS_SPACE, MinHasher, char_hashes, char_shingles, chunks, utf8_buffers

#: Runs of 2**3 code points; two lines are the same if the Jaccard similarity of their sets is at least 0.8.
DOUBLINGS = 3
THRESHOLD = 0.8
#: Every line with a word takes part; lines without one (empty or blank) part paragraphs and stay.
LEAST_CHARS = 1
ROWS, BANDS = 4, 12
HASHER = MinHasher(ROWS * BANDS, seed=10)
#: Bytes of text whose lines are hashed at a time: what the processor's cache holds.
CHUNK = 256 << 10
#: Line numbers that may be broadcast.
BROADCAST_LINES = 1_000_000


def _lines(data: np.ndarray, starts: np.ndarray, least: int):
    """Of the lines with a word and `least` code points or more: all text and code points, each line's text, number in it, byte span and code-point span."""
    text = data.tobytes()
    begin, end = np.concatenate([starts[:-1], np.flatnonzero(data == 10) + 1]), np.concatenate([starts[1:], np.flatnonzero(data == 10)])
    begin, end = np.sort(begin), np.sort(end)
    doc = np.minimum(np.searchsorted(starts, begin, "right") - 1, len(starts) - 2)
    # empty lines of texts before may begin where a text does; its own first line is the last of those, and they have no word
    first = np.searchsorted(begin, starts[:-1], "right") - 1
    number = np.arange(len(begin)) - first[doc]
    solid = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~IS_SPACE[data], out=solid[1:])
    if (data < 0x80).all():
        points, a, b = data, begin, end
    else:
        points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        a, b = lead[begin].astype(np.int64), lead[end].astype(np.int64)
    keep = (b - a >= least) & (solid[end] > solid[begin])
    return text, points, doc[keep], number[keep], begin[keep], end[keep], a[keep], b[keep]


def _occurrences(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """doc_id, row_hash, text in; a row for each line out: doc_id, row_hash, line, id, node, bytes, and the line's signature.

    sig is null for lines without a run, which have no set to compare, and where the same line stands before in this piece of the batch."""
    runs = max(least, 1 << DOUBLINGS)
    for batch in batches:
        data, starts = utf8_buffers(batch.column("text"))
        for lo, hi in chunks(starts, CHUNK):
            text, points, doc, number, begin, end, a, b = _lines(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], least)
            if not len(doc):
                continue
            ids = [xxhash.xxh3_128_digest(text[i:j]) for i, j in zip(begin.tolist(), end.tolist())]
            nodes = np.frombuffer(b"".join(x[:8] for x in ids), np.int64)
            new = np.unique(nodes, return_index=True)[1]
            new = np.sort(new[(b - a)[new] >= runs])
            sig = HASHER.signatures(*char_hashes(points, a[new], b[new], DOUBLINGS))
            sizes = np.zeros(len(ids), np.int32)
            sizes[new] = 2 * ROWS * BANDS
            valid = np.packbits(sizes > 0, bitorder="little")
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(ids), [pa.py_buffer(valid.tobytes()), pa.py_buffer(offsets), pa.py_buffer(sig)])
            at = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("row_hash").take(at), pa.array(number.astype(np.int32)), pa.array(ids, pa.binary()), pa.array(nodes), pa.array(end - begin), column],
                names=["doc_id", "row_hash", "line", "id", "node", "bytes", "sig"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, sig -> rows for near.candidate_groups."""
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(utf8_buffers(batch.column(1))[0].tobytes(), np.uint16).reshape(batch.num_rows, ROWS * BANDS)
            yield near.band_batch(batch.column(0).to_numpy(), MinHasher.band_keys(sig), sig)


def _line_shingles(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    data, starts = utf8_buffers(table.column("line_text"))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[starts]
    return char_shingles(points, at[:-1], at[1:], DOUBLINGS)


def _line_texts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (id, grp, bytes, first) -> members with line_text, read from the documents that hold their first places only; repeated rows repeat."""
    wanted = candidates.groupBy(F.col("first.doc_id").alias("at_doc"), F.col("first.row_hash").alias("at_hash")).agg(F.collect_list(F.struct("id", "grp", "first.line")).alias("wanted"))
    few = candidates.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES // 4
    wanted = F.broadcast(wanted) if few else wanted
    d = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["at_doc"]) & (docs["row_hash"] == wanted["at_hash"]))
    # transform over a one-element array binds the lines to a variable, so that a text is split once
    member = lambda parts: F.transform("wanted", lambda w: F.struct(w["id"], w["grp"], F.get(parts, w["line"]).alias("line_text")))
    found = d.select(F.explode(F.element_at(F.transform(F.array(F.split("text", "\n", -1)), member), 1)).alias("m"))
    return found.select("m.id", "m.grp", "m.line_text", F.lit(1).cast("long").alias("copies"))


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, row_hash, text) -> (doc_id, row_hash, line): the lines that repeat an earlier one, fuzzily or exactly.

    Of each component of similar lines the first by (doc_id, row_hash, line number) stays, null doc_ids first. The texts are split and hashed once; what
    follows reads the table of lines, and the texts of documents that hold a candidate."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, row_hash long, line int, id binary, node long, bytes long, sig binary"
    lines = materialize(docs.select("doc_id", "row_hash", "text").mapInArrow(lambda it: _occurrences(it, least_chars), schema), "lines")
    signed = lines.where("sig is not null").select("node", "sig")
    bands = signed.mapInArrow(near.packer(_bands, lines.count() * BANDS), near.PACKED_SCHEMA)
    groups = near.candidate_groups(bands, signed, ROWS * BANDS, threshold)
    place = F.struct("doc_id", "row_hash", "line")
    held = lines.drop("sig").join(near.small_side(groups), "node")
    candidates = materialize(held.groupBy("id").agg(F.first("grp").alias("grp"), F.first("bytes").alias("bytes"), F.min(place).alias("first")), "candidates")
    roots, _ = near.verified(_line_texts(docs, candidates), candidates, near.verifier(_line_shingles, threshold), False)
    exact = lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    exact = materialize(exact.join(roots, "id", "left").where("n > 1 or root is not null").select("id", F.coalesce("root", "id").alias("root"), "first"), "repeated")
    keepers = exact.groupBy("root").agg(F.min("first").alias("keep"))
    exact = near.small_side(materialize(exact.join(keepers, "root").select("id", "keep"), "keepers"))
    return lines.select("doc_id", "row_hash", "line", "id").join(exact, "id").where(~place.eqNullSafe(F.col("keep"))).select("doc_id", "row_hash", "line")


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) -> the same rows and columns, text without the lines that repeat an earlier one, and n_lines, n_removed (long).

    Lines are split at \\n. Lines without a word always stay, and any under `least_chars` code points. Two lines are similar if they are equal or if the
    Jaccard similarity of their sets of eight-character runs is at least `threshold` (lines under eight characters have no runs); one line of each connected component stays, the first by (doc_id, text hash, line number).
    Rows that agree in doc_id and text are one document: all copies keep the same lines. A null or empty text is unchanged and has no lines to remove.
    An empty table gives an empty one. Columns named n_lines or n_removed are replaced; other extra columns pass through; names that begin with __sky are reserved."""
    row = docs.drop("n_lines", "n_removed").withColumn("__sky_row", F.xxhash64("text"))
    slim = row.select("doc_id", F.col("__sky_row").alias("row_hash"), "text")
    gone = materialize(dropped_lines(slim, least_chars, threshold).groupBy("doc_id", "row_hash").agg(F.collect_set("line").alias("__sky_gone")), "gone")
    gone = gone.select(F.col("doc_id").alias("__sky_gone_doc"), F.col("row_hash").alias("__sky_gone_hash"), "__sky_gone")
    sizes = gone.agg(F.count("*") + F.sum(F.size("__sky_gone"))).first()[0] or 0
    gone = F.broadcast(gone) if sizes <= BROADCAST_LINES else gone
    joined = row.join(gone, row["doc_id"].eqNullSafe(gone["__sky_gone_doc"]) & (row["__sky_row"] == gone["__sky_gone_hash"]), "left")
    # array_except hashes the numbers of the lines that go, so that a text's lines are looked through once; transform over one element splits it once
    staying = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__sky_gone"), lambda i: F.get(parts, i))
    kept = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), lambda parts: F.array_join(staying(parts), "\n")), 1)
    return joined.select(
        *(F.when(F.col("__sky_gone").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else row[c] for c in row.columns if c != "__sky_row"),
        F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("__sky_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines: doc_id, text, n_lines, n_removed."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Of the sets' rarest runs, a fifth and one are joined: two sets that share four fifths share one of those. doc_id tells documents apart here.
ORACLE = r"""
WITH RECURSIVE o AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), q AS (
  SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM o) WHERE regexp_matches(parts[i], '[^\x20\x09-\x0D]')
), k AS (
  SELECT line, row_number() OVER () AS cid, min(struct_pack(d := doc_id, i := i)) AS place FROM q GROUP BY line
), s AS (
  SELECT DISTINCT cid, unnest(list_transform(range(1, length(line) - 6), lambda i: hash(substr(line, i, 8)))) AS h FROM k WHERE length(line) >= 8
), f AS (
  SELECT cid, h, count(*) OVER (PARTITION BY cid) AS n, row_number() OVER (PARTITION BY cid ORDER BY c, h) AS nr FROM s JOIN (SELECT h, count(*) AS c FROM s GROUP BY h) USING (h)
), p AS (
  SELECT DISTINCT a.cid AS a, b.cid AS b, a.n AS na, b.n AS nb FROM f a JOIN f b ON a.h = b.h AND a.cid < b.cid WHERE a.nr <= a.n // 5 + 1 AND b.nr <= b.n // 5 + 1 AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9
), l AS (
  SELECT a, b FROM (SELECT a, b, na, nb, count(*) AS c FROM p JOIN s x ON x.cid = a JOIN s y ON y.cid = b AND y.h = x.h GROUP BY ALL) WHERE c >= 0.8::DOUBLE * (na + nb - c) - 1e-9::DOUBLE
), e AS (
  SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT cid AS x, cid AS y FROM k UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
), c AS (
  SELECT r.x AS cid, min(place) AS keep FROM r JOIN k ON k.cid = r.y GROUP BY r.x
), g AS (
  SELECT q.doc_id, list(q.i) AS gone FROM q JOIN k USING (line) JOIN c USING (cid) WHERE NOT (q.doc_id = c.keep.d AND q.i = c.keep.i) GROUP BY q.doc_id
)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(parts, lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text,
  coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed FROM o LEFT JOIN g USING (doc_id)
"""
