"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import near
from skysift.llm.storage import materialize
from skysift.llm.textkit import MinHasher, chunks, utf8_buffers, word_hashes, word_shingles

WORDS = 5
THRESHOLD = 0.8
ROWS, BANDS = 4, 24
STEP = 16
TOLERANCE = 1e-6
HASHER = MinHasher(ROWS * BANDS, seed=8)


def bayesian_pruner(threshold: float, tolerance: float):
    gates = near.least_matches(ROWS * BANDS, threshold, tolerance, STEP)

    def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        left = np.arange(len(i))
        matches = np.zeros(len(i), np.int32)
        done = 0
        for n, least in gates:
            matches += (sig[i[left], done:n] == sig[j[left], done:n]).sum(1, dtype=np.int32)
            keep = matches >= least
            left, matches = left[keep], matches[keep]
            done = n
            if len(left) == 0:
                break
        return left

    return prune


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = utf8_buffers(batch.column(1))
        for lo, hi in chunks(starts):
            words, firsts = word_hashes(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
            signatures = HASHER.signatures(*word_shingles(words, firsts, WORDS))
            raw = words.tobytes()
            ids = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            nodes = np.frombuffer(b"".join(x[:8] for x in ids), np.int64)
            empty = np.diff(firsts) == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(nodes), pa.array([s.tobytes() for s in signatures], pa.binary()), pa.array(empty), pa.array(np.diff(starts[lo : hi + 1]))],
                names=["doc_id", "row_hash", "id", "node", "sig", "empty", "bytes"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        yield near.band_batch(batch.column(0).to_numpy(), MinHasher.band_keys(sig), sig)


def _text_shingles(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts, sizes = [], [np.zeros(1, np.int64)]
    data, starts = utf8_buffers(table.column("text"))
    for lo, hi in chunks(starts):
        s, ends = word_shingles(*word_hashes(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]), WORDS)
        parts.append(s)
        sizes.append(np.diff(ends))
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def _classes(docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_hash, id) for each row, and (id, root, rep, n_links) for each distinct text; row_hash is of the text as it is."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bare = docs.select("doc_id", "text")
    signed = bare.select("doc_id", "text", F.xxhash64("text").alias("row_hash")).mapInArrow(_sign, f"doc_id {id_type}, row_hash long, id binary, node long, sig binary, empty boolean, bytes long")
    signed = materialize(signed, "signed")
    classes = signed.groupBy("id").agg(
        F.min(F.struct("doc_id", "row_hash")).alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("node", "sig", "empty", "bytes"))
    )
    classes = materialize(classes, "classes")
    bands = classes.where("not empty").select("node", "sig").mapInArrow(near.packer(_bands, classes.count() * BANDS), near.PACKED_SCHEMA)
    groups = near.candidate_groups(bands, classes.where("not empty").select("node", "sig"), ROWS * BANDS, threshold, tolerance)
    members = materialize(classes.join(groups, "node").select("grp", "id", "rep", "copies", "sig", "bytes"), "members")
    named = near.small_side(members.select(F.col("rep.doc_id").alias("__sky_doc"), F.col("rep.row_hash").alias("__sky_hash"), "id"))
    texts = bare.join(named, bare["doc_id"].eqNullSafe(named["__sky_doc"]) & (F.xxhash64(bare["text"]) == named["__sky_hash"])).select("id", "text").dropDuplicates(["id"])
    rows = members.drop("rep", "bytes").join(texts, "id")
    roots, links = near.verified(rows, members, near.verifier(_text_shingles, threshold, bayesian_pruner(threshold, tolerance)))
    classes = classes.select("id", "rep", "copies").join(roots, "id", "left").join(links, "id", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    return signed.select("doc_id", "row_hash", "id"), materialize(classes.select("id", F.coalesce("root", "id").alias("root"), "rep", n_links), "linked")


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, class_id, n_links), a row for each row of docs.

    Two documents are linked if the Jaccard similarity of their sets of five-word runs is at least `threshold`. A text of one to four words has
    one run, of all its words; texts without words are equal to each other only; null counts as empty. class_id: the least doc_id of the connected
    component, null first; n_links: the other documents linked to it, equal copies included. Repeated rows count as copies.
    Candidates: 24 bands of 4 MinHash values, which a pair at the threshold misses with probability 3e-6."""
    signed, classes = _classes(docs, threshold, tolerance)
    named = classes.groupBy("root").agg(F.min("rep").getField("doc_id").alias("class_id"))
    named = classes.join(named, "root").select("id", "class_id", "n_links")
    return signed.select("doc_id", "id").join(named, "id").select("doc_id", "class_id", "n_links")


def survivors(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs -> one row of each class, with all its columns: that of the least (doc_id, hash of the text), null doc_ids first. Repeated rows leave one.

    Column names that begin with __sky are reserved."""
    _, classes = _classes(docs, threshold, tolerance)
    keep = materialize(classes.groupBy("root").agg(F.min("rep").alias("r")).select(F.col("r.doc_id").alias("__sky_keep"), F.col("r.row_hash").alias("__sky_keep_hash")), "survivors")
    keep = near.small_side(keep)
    d = docs.withColumn("__sky_row", F.xxhash64("text"))
    left = d.join(keep, d["doc_id"].eqNullSafe(keep["__sky_keep"]) & (d["__sky_row"] == keep["__sky_keep_hash"]), "left_semi")
    return left.dropDuplicates(["doc_id", "__sky_row"]).select(*docs.columns)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and number of links over all documents."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), k AS (
  SELECT ws, row_number() OVER () AS cid, count(*) AS copies, bool_or(doc_id IS NULL) AS nameless, min(doc_id) AS least FROM d GROUP BY ws
), s AS (
  SELECT DISTINCT cid, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: hash(ws[i:i + 4])) ELSE [hash(ws)] END) AS h FROM k WHERE len(ws) > 0
), z AS (
  SELECT cid, count(*) AS n FROM s GROUP BY cid
), l AS (
  SELECT p.a, p.b FROM (SELECT x.cid AS a, y.cid AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.cid < y.cid GROUP BY ALL) p JOIN z za ON za.cid = a JOIN z zb ON zb.cid = b WHERE c >= 0.8::DOUBLE * (za.n + zb.n - c) - 1e-9::DOUBLE
), e AS (
  SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT cid AS x, cid AS y FROM k UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
), c AS (
  SELECT r.x AS cid, CASE WHEN bool_or(nameless) THEN NULL ELSE min(least) END AS class_id FROM r JOIN k ON k.cid = r.y GROUP BY r.x
), n AS (
  SELECT e.x AS cid, sum(copies) AS links FROM e JOIN k ON k.cid = e.y GROUP BY e.x
)
SELECT d.doc_id, c.class_id, (coalesce(links, 0) + copies - 1)::BIGINT AS n_links FROM d JOIN k ON k.ws = d.ws JOIN c ON c.cid = k.cid LEFT JOIN n ON n.cid = k.cid
"""
