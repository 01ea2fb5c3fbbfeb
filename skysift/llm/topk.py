"""Exact top-k inner products on a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysift.llm.storage import materialize

#: Rows of an index block and queries of a query block: what one kernel call holds.
ROWS, QUERIES = 4096, 256
#: Low bits that the slices leave out; they decide the boundary rows.
LOW_BITS = 3
#: Scores are longs; one that does not fit is given as the nearest long, ranks follow the exact score.
MOST_SCORE = 2**63 - 1


def wide_from(dims: int) -> int:
    """Vectors with a component of this size or more are wide: sums of their products might not fit 64 bits, so they are multiplied as whole numbers of any length."""
    return 1 << (30 - (dims.bit_length() + 1) // 2)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(ids, vectors, wide) of up to `most` rows each: quantised, or the doubles themselves if wide. Vectors that are null, or hold null or non-finite components, are left out."""
    held: dict[tuple[int, bool], list] = {}
    counts: dict[tuple[int, bool], int] = {}

    def full(key: tuple[int, bool], rest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        ids, vectors = (np.concatenate(x) for x in zip(*held[key]))
        end = len(ids) if rest else len(ids) - len(ids) % most
        for k in range(0, end, most):
            yield ids[k : min(k + most, end)], vectors[k : min(k + most, end)], key[1]
        held[key], counts[key] = [(ids[end:], vectors[end:])], len(ids) - end

    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        sizes = np.array([-1 if v is None else v for v in vectors.value_lengths().to_pylist()]) if len(vectors) else np.zeros(0, int)
        for size in np.unique(sizes[sizes > 0]).tolist():
            pick = np.flatnonzero(sizes == size)
            flat = vectors.take(pa.array(pick)).flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(256 * x)
                wide = (np.abs(q) >= wide_from(size)).any(axis=1)
            ok = np.isfinite(x).all(axis=1)
            for w in (False, True):
                rows = np.flatnonzero(ok & (wide == w))
                for at in range(0, len(rows), most):
                    part = rows[at : at + most]
                    held.setdefault((size, w), []).append((ids[pick][part], x[part] if w else q[part].astype(np.int32)))
                    counts[size, w] = counts.get((size, w), 0) + len(part)
                    if counts[size, w] >= most:
                        yield from full((size, w), False)
    for key in list(held):
        if counts[key]:
            yield from full(key, True)


INDEX_SCHEMA = "wide boolean, dims int, n int, ids binary, exact binary, widths binary, slices binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: row bitmaps of every attribute's bits from LOW_BITS up, least significant first, as unsigned offsets from its least value. Wide blocks have none."""
    for ids, x, wide in _blocks(batches, ROWS):
        if wide:
            yield _row(x, ids, np.zeros(0, np.int64), b"", True)
            continue
        u = (x.astype(np.int64) - x.min(axis=0)) >> LOW_BITS
        widths = np.array([int(v).bit_length() for v in u.max(axis=0)], np.int64)
        bits = [((u[:, d] >> b) & 1).astype(np.uint8) for d in range(x.shape[1]) for b in range(widths[d])]
        padded = np.zeros((len(bits), -(-len(ids) // 64) * 64), np.uint8)
        if bits:
            padded[:, : len(ids)] = np.stack(bits)
        yield _row(x, ids, widths, np.packbits(padded, axis=1, bitorder="little").tobytes(), False)


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, x, wide in _blocks(batches, QUERIES):
        yield _row(x, ids, np.zeros(0, np.int64), b"", wide)


def _row(x: np.ndarray, ids: np.ndarray, widths: np.ndarray, slices: bytes, wide: bool) -> pa.RecordBatch:
    arrays = [pa.array([wide]), *(pa.array([v], pa.int32()) for v in (x.shape[1], len(ids)))] + [pa.array([b], pa.binary()) for b in (ids.astype(np.int64).tobytes(), np.ascontiguousarray(x).tobytes(), widths.tobytes(), slices)]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in INDEX_SCHEMA.split(", ")])


def signed_digits(w: int) -> list[tuple[int, int]]:
    """w as few signed powers of two: (exponent, 1 or -1)."""
    out, e = [], 0
    while w:
        if w & 1:
            d = 2 - (w & 3)
            out.append((e, d))
            w -= d
        w >>= 1
        e += 1
    return out


def add_slices(levels: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bitmaps by power of two, added up by carry-save adders; one bitmap per power is left, least significant first."""
    out = []
    p, top = 0, max(levels, default=-1)
    while p <= top:
        stack = levels.get(p, [])
        m = np.concatenate(stack) if stack else np.zeros((0, 0), np.uint64)
        while len(m) > 2:
            k = len(m) // 3
            a, b, c = m[:k], m[k : 2 * k], m[2 * k : 3 * k]
            x = a ^ b
            levels.setdefault(p + 1, []).append((a & b) | (x & c))
            m = np.concatenate([x ^ c, m[3 * k :]])
        if len(m) == 2:
            levels.setdefault(p + 1, []).append(m[:1] & m[1:])
            m = m[:1] ^ m[1:]
        top = max(levels, default=-1)
        out.append(m[0] if len(m) else None)
        p += 1
    return out


def top_bitmap(slices: list[np.ndarray | None], valid: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """From the most significant slice down: the k largest sums and all that tie with the last of them; and the least sum among them."""
    sure, maybe, floor, alive = np.zeros_like(valid), valid.copy(), 0, k
    for p in range(len(slices) - 1, -1, -1):
        s = slices[p]
        here = maybe & s if s is not None else np.zeros_like(valid)
        n = int(np.bitwise_count(here).sum())
        if n >= alive:
            maybe = here
            floor += 1 << p
        else:
            sure |= here
            maybe = maybe & ~s if s is not None else maybe
            alive -= n
    return sure | maybe, floor


def at_least(slices: list[np.ndarray | None], valid: np.ndarray, bound: int) -> np.ndarray:
    """Bitmap of the rows whose sum is at least bound."""
    if bound <= 0:
        return valid
    if bound >> len(slices):
        return np.zeros_like(valid)
    greater, equal = np.zeros_like(valid), valid.copy()
    for p in range(len(slices) - 1, -1, -1):
        s = slices[p] if slices[p] is not None else np.zeros_like(valid)
        if bound >> p & 1:
            equal = equal & s
        else:
            greater |= equal & s
            equal = equal & ~s
    return greater | equal


def search_block(query: np.ndarray, widths: np.ndarray, slices: np.ndarray, first: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Row numbers that may be among the k best of a block, the k best certainly among them."""
    levels: dict[int, list[np.ndarray]] = {}
    picks: dict[tuple[int, int], list[int]] = {}
    slack = int(np.abs(query).sum()) * ((1 << LOW_BITS) - 1)
    for d, w in enumerate(query.tolist()):
        for e, sign in signed_digits(w):
            for b in range(widths[d]):
                picks.setdefault((e + b, sign), []).append(first[d] + b)
    for (p, sign), at in picks.items():
        # -x of a bit is (not x) - 1: the constant is the same for all rows and does not change their order
        levels.setdefault(p, []).append(slices[at] if sign > 0 else slices[at] ^ np.uint64(0xFFFFFFFFFFFFFFFF))
    sums = add_slices(levels)
    n = int(np.bitwise_count(valid).sum())
    if n > k and sums:
        _, floor = top_bitmap(sums, valid, k)
        valid = at_least(sums, valid, floor - -(-slack // (1 << LOW_BITS)) - 1)
    return np.flatnonzero(np.unpackbits(valid.view(np.uint8), bitorder="little"))


def _numbers(raw: bytes, n: int, wide: bool, whole: bool) -> np.ndarray:
    """A block's vectors as 64-bit integers, or as Python integers if either side of a product is wide: floor(256 x) of a double is exact as a ratio."""
    x = np.frombuffer(raw, np.float64 if wide else np.int32).reshape(n, -1)
    if not wide:
        return x.astype(object) if whole else x.astype(np.int64)
    ratios = (v.as_integer_ratio() for v in x.ravel().tolist())
    return np.array([256 * a // b for a, b in ratios], object).reshape(x.shape)


def _best_whole(ids: np.ndarray, exact: np.ndarray, qid: int, q: np.ndarray, k: int) -> list[tuple]:
    """The k best of a block by products of Python integers: (query, row, score as the nearest long, text that orders scores beyond a long)."""
    rows = np.flatnonzero(ids != qid)
    scores = (exact[rows] @ q).tolist() if len(rows) else []
    best = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]
    beyond = lambda s: f"{s + (1 << 2300):0600x}" if abs(s) >= MOST_SCORE else None
    return [(qid, int(ids[rows[i]]), max(-MOST_SCORE - 1, min(MOST_SCORE, scores[i])), beyond(scores[i])) for i in best]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                ids, qids = (np.frombuffer(r[c], np.int64) for c in ("ids", "q_ids"))
                whole = r["wide"] or r["q_wide"]
                exact = _numbers(r["exact"], len(ids), r["wide"], whole)
                queries = _numbers(r["q_exact"], len(qids), r["q_wide"], whole)
                if whole:
                    for qid, q in zip(qids.tolist(), queries):
                        out += _best_whole(ids, exact, qid, q, k)
                    continue
                widths = np.frombuffer(r["widths"], np.int64)
                words = -(-len(ids) // 64)
                slices = np.frombuffer(r["slices"], np.uint64).reshape(-1, words)
                first = np.concatenate([[0], np.cumsum(widths)]).tolist()
                every = np.packbits(np.pad(np.ones(len(ids), np.uint8), (0, words * 64 - len(ids))), bitorder="little").view(np.uint64)
                widths = widths.tolist()
                for qid, q in zip(qids.tolist(), queries):
                    valid = every
                    if (own := np.flatnonzero(ids == qid)).size:
                        valid = every.copy()
                        np.bitwise_and.at(valid, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
                    rows = search_block(q, widths, slices, first, valid, k)
                    scores = exact[rows] @ q
                    best = np.lexsort((ids[rows], -scores))[:k]
                    out += zip([qid] * len(best), ids[rows[best]].tolist(), scores[best].tolist(), [None] * len(best))
            a, b, c, d = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (a, b, c)), pa.array(d, pa.string())], names=["query_id", "vec_id", "score", "beyond"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors (vec_id, embedding), queries (vec_id, embedding) -> (query_id, rank, vec_id, score): the k highest inner products of floor(256 x).

    Ties go to the smaller vec_id; a query does not meet rows of its own vec_id; all candidates come if there are fewer than k. Vectors that are null,
    empty, or hold null or non-finite components, and rows of null vec_id, take no part; vectors of another length than the query's are no candidates.
    Repeated rows are candidates each; repeated query rows are one query, and queries that share a vec_id are answered together. Any finite component
    will do: wide vectors are multiplied as whole numbers of any length, and a score beyond a long is given as the nearest long, ranked by what it is.
    The index has a row for each 4096 vectors; query blocks meet index blocks on a shared lane number, so that a kernel call holds one of each. Every
    row is indexed and the result is exact. Empty tables give an empty one; extra columns, whatever their names, are not read."""
    vectors, queries = (d.select("vec_id", "embedding").where("vec_id is not null") for d in (vectors, queries))
    queries = queries.dropDuplicates(["vec_id", "embedding"])
    index = materialize(vectors.mapInArrow(_index, INDEX_SCHEMA), "slices")
    lanes = max(1, min(index.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = index.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)))
    q = queries.coalesce(max(1, lanes // 4)).mapInArrow(_query_blocks, INDEX_SCHEMA).select(*(F.col(c).alias(f"q_{c}") for c in ("dims", "ids", "exact", "wide")))
    q = q.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    # shuffled: the query blocks of all lanes are too many for the driver, though their estimate may look small enough to broadcast
    met = blocks.join(q.hint("merge"), (blocks["lane"] == q["lane"]) & (F.col("dims") == F.col("q_dims"))).select("ids", "exact", "widths", "slices", "wide", "q_ids", "q_exact", "q_wide")
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long, beyond string")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every vector whose vec_id is divisible by 50, against all vectors."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(v, v.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
