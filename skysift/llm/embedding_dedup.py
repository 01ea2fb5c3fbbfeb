"""Embedding near-duplicates: random projections decoded to E8 lattice points in several tables, neighbouring cells probed, cosines verified."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, product
from math import acos, ceil, comb, log, log1p, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.graph import components, roots_of
from skysift.llm.near import _all_pairs, forest, small_side
from skysift.llm.storage import materialize
from skysift.llm.textkit import changes, mix, whole_runs

THRESHOLD = 0.9
#: Share of pairs exactly at the threshold that the tables find; nearer pairs are found more often.
RECALL = 0.995
#: Projected coordinates of a unit vector have this standard deviation, in units in which the lattice's least distance is the root of two; neighbouring cells
#: that each table probes beside a vector's own; rows of unrelated vectors that a cell may hold on average.
SCALE, PROBES, CROWD = 0.5, 8, 16
#: Sign bits of a sketch, and those in which a vector may differ from its cell's first one and be represented by it.
BITS, ABSORBED = 512, 12
#: Probability with which a pair at the threshold differs in more sketch bits than the gate lets pass.
TOLERANCE = 1e-8
#: Members of a cell that are compared all with all; members of a block of a group; rows of a kernel's product.
BUCKET, BLOCK, TILE = 8192, 4096, 512
#: Cells of so many members or fewer are judged many at a time.
SMALL = 16

CELLS_SCHEMA = "key long, node long, sketch binary"


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 least vectors of E8: two coordinates of 1 or -1, or eight of a half with an even number of minus signs."""
    pairs = [[s if k == i else t if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for s in (1.0, -1.0) for t in (1.0, -1.0)]
    halves = [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight: of whole numbers with an even sum, or such a point moved by a half in every coordinate."""

    def even(x: np.ndarray) -> np.ndarray:
        p = np.rint(x)
        off = x - p
        worst = np.abs(off).argmax(-1)[..., None]
        step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
        odd = (p.sum(-1, keepdims=True) % 2).astype(bool)
        np.put_along_axis(p, worst, np.take_along_axis(p, worst, -1) + np.where(odd, step, 0.0), -1)
        return p

    whole, half = even(x), even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(-1, keepdims=True) <= ((x - half) ** 2).sum(-1, keepdims=True)
    return np.where(nearer, whole, half)


@functools.cache
def tables_for(blocks: int, threshold: float, recall: float) -> int:
    """Tables with which a pair at the threshold meets in a cell with this probability; what one table finds is measured on seeded random pairs."""
    rng, n = np.random.default_rng(8), 20_000
    x = rng.normal(size=(n, blocks, 8))
    y = threshold * x + (1 - threshold**2) ** 0.5 * rng.normal(size=x.shape)
    x, y = SCALE * x, SCALE * y
    hx, hy = decode(x), decode(y)
    same = (hx == hy).all(-1)
    found = same.all(-1)
    one = np.flatnonzero(same.sum(-1) == blocks - 1)
    at = (~same[one]).argmax(-1)
    for a, ha, hb in ((x, hx, hy), (y, hy, hx)):
        closeness = ((a - ha)[one] @ neighbours().T).reshape(len(one), -1)
        least = np.partition(closeness, -PROBES, axis=1)[:, -PROBES]
        step = (hb - ha)[one, at]
        found[one] |= (np.abs((step**2).sum(-1) - 2) < 1e-9) & (((a - ha)[one, at] * step).sum(-1) >= least)
    return max(1, ceil(log(1 - recall) / log1p(-min(float(found.mean()), 1 - 1e-9))))


@functools.cache
def _meeting() -> float:
    """How often unrelated vectors share a lattice point: measured on seeded random pairs."""
    a, b = (decode(SCALE * np.random.default_rng(seed).normal(size=(200_000, 8))) for seed in (5, 6))
    return float((a == b).all(-1).mean())


def blocks_for(n: int) -> int:
    """Lattice points that make up a cell, two at least, so that about CROWD of n unrelated vectors share one."""
    return max(2, ceil(log(max(n, 1) / CROWD) / -log(_meeting()))) if n > CROWD else 2


@functools.cache
def most_bits(threshold: float) -> int:
    """The sketch bits in which a pair at the threshold differs, but for a share of TOLERANCE."""
    p, tail, k = acos(threshold) / pi, 0.0, BITS
    while k > 0:
        tail += comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
        if tail > TOLERANCE:
            return k
        k -= 1
    return 0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding in; vec_id, a hash of the vector, its first eight bytes and the vector at length one out, null where a vector can't be compared."""
    for batch in batches:
        vectors = batch.column(1)
        size = np.array([x or 0 for x in vectors.value_lengths().to_pylist()], np.int64)
        x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
        end = np.cumsum(size)
        ids, units = [], []
        for a, b in zip((end - size).tolist(), end.tolist()):
            v = x[a:b]
            top = np.abs(v).max() if b > a else 0.0
            if not (0 < top < np.inf):  # empty, zero, null, NaN or infinite
                ids.append(None)
                units.append(None)
                continue
            u = v / top
            ids.append(xxhash.xxh3_128_digest(v.tobytes()))
            units.append((u / np.sqrt((u * u).sum())).tobytes())
        nodes = [x and int.from_bytes(x[:8], "little", signed=True) for x in ids]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())], names=["vec_id", "id", "node", "unit"])


def _keys(unit: np.ndarray, blocks: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: the keys of their own cells and of the neighbouring ones nearest to them in all tables, and their sketches."""
    n, dims = unit.shape
    rng = np.random.default_rng([12, dims])
    sketch = np.packbits(unit @ rng.normal(size=(dims, BITS)) > 0, axis=1)
    planes = rng.normal(size=(dims, tables * blocks * 8)) * SCALE
    odd = rng.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    place = mix(np.arange(1, tables * blocks + 1, dtype=np.uint64) + np.uint64(dims << 32)).reshape(1, tables, blocks, 1)
    name = lambda p: ((2 * p).astype(np.int64).astype(np.uint64) * odd).sum(-1, dtype=np.uint64)
    out = np.empty((n, tables, 1 + PROBES), np.uint64)
    for at in range(0, n, TILE):
        x = (unit[at : at + TILE] @ planes).reshape(-1, tables, blocks, 8)
        home = decode(x)
        closeness = ((x - home).astype(np.float32) @ neighbours().T.astype(np.float32)).reshape(len(x), tables, -1)
        best = np.argpartition(closeness, -PROBES, axis=2)[..., -PROBES:]
        block, step = np.divmod(best, 240)
        term = mix(name(home)[..., None] ^ place)[..., 0]
        total = term.sum(-1, dtype=np.uint64)
        moved = name(np.take_along_axis(home, block[..., None], 2) + neighbours()[step])
        moved = mix(moved ^ np.take_along_axis(np.broadcast_to(place[..., 0], term.shape), block, 2))
        out[at : at + TILE, :, 0] = total
        out[at : at + TILE, :, 1:] = total[..., None] - np.take_along_axis(term, block, 2) + moved
    return mix(out).reshape(n, -1).view(np.int64), sketch


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _cells(blocks: int, tables: int):
    """node, unit in; a row for each cell that a vector lies in or next to. Within a batch, a vector whose sketch is nearly that of its cell's first one goes no
    further there: a row (node, first one's node, null) stands for it."""

    def one(nodes: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, sketch = _keys(unit, blocks, tables)
        bits = np.ascontiguousarray(sketch).view(np.uint64)
        flat, at = keys.ravel(), np.repeat(np.arange(len(nodes)), keys.shape[1])
        order = np.lexsort((at, flat))
        flat, at = flat[order], at[order]
        head = np.concatenate([[True], flat[1:] != flat[:-1]])
        hub = at[np.maximum.accumulate(np.where(head, np.arange(len(flat)), 0))]
        again = np.flatnonzero(~head)
        close = again[_distance(bits[at[again]], bits[hub[again]]) <= ABSORBED]
        stays = np.ones(len(flat), bool)
        stays[close] = False
        flat, own = flat[stays], at[stays]
        linked = close[nodes[at[close]] != nodes[hub[close]]]
        for lo in range(0, len(flat), 65536):
            part = own[lo : lo + 65536]
            raw = pa.py_buffer(sketch[part].tobytes())
            ends = pa.py_buffer((np.arange(len(part) + 1) * (BITS // 8)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(flat[lo : lo + 65536]), pa.array(nodes[part]), pa.Array.from_buffers(pa.binary(), len(part), [None, ends, raw])], names=["key", "node", "sketch"])
        if len(linked):
            pairs = np.unique(np.stack([nodes[at[linked]], nodes[hub[linked]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.binary())], names=["key", "node", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, units = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size = np.array([len(u) for u in units])
            for s in np.unique(size).tolist():
                pick = np.flatnonzero(size == s)
                yield from one(nodes[pick], np.frombuffer(b"".join(units[i] for i in pick.tolist()), np.float64).reshape(len(pick), -1))

    return run


def _capped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: a cell's members past the first BUCKET become links to its first one, unpruned, so that none is lost and no task holds more."""
    last, first, seen = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(i).to_numpy() for i in (0, 1))
        head = np.flatnonzero(np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]]))
        begin = np.full(len(key), -1)
        begin[head] = head
        begin = np.maximum.accumulate(begin)
        rank = np.where(begin >= 0, np.arange(len(key)) - begin, np.arange(len(key)) + seen)
        hub = np.where(begin >= 0, node[np.maximum(begin, 0)], first)
        ready = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        late = (rank >= BUCKET) & ~ready
        yield batch.filter(pa.array(~late))
        if late.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[late]), pa.array(hub[late]), pa.nulls(int(late.sum()), pa.binary())], names=["key", "node", "sketch"])
        last, first, seen = key[-1], hub[-1], int(rank[-1]) + 1


def _links(most: int):
    """Rows of cells, sorted by key, in; edges out: in each cell a spanning forest of the pairs whose sketches differ in `most` bits or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(_capped(batches), ["key"], 65536, 32 << 20):
            ready = table.column("sketch").is_null().to_numpy()
            key, node = (table.column(c).to_numpy() for c in ("key", "node"))
            a, b = [key[ready]], [node[ready]]
            key, node = key[~ready], node[~ready]
            if len(key):
                bits = np.frombuffer(b"".join(table.column("sketch").drop_null().to_pylist()), np.uint64).reshape(len(key), -1)
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(start, len(key)))
                few = (size > 1) & (size <= SMALL)
                i, j = _all_pairs(size[few], start[few])
                near = _distance(bits[i], bits[j]) <= most
                a.append(node[i[near]])
                b.append(node[j[near]])
                for k, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
                    x, y = forest(bits[k : k + n], lambda p, q: _distance(p, q) <= most)
                    a.append(node[k + x])
                    b.append(node[k + y])
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def _verified(threshold: float):
    """Rows (grp, bi, bj, block, id, copies, unit) sorted by (grp, bi, bj, id): each vector's root among those it meets there, and rows linked to it."""

    def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(n, -1)
        block, copies = table.column("block").to_numpy(), table.column("copies").to_numpy().astype(np.float64)
        across = table.column("bi")[0].as_py() != table.column("bj")[0].as_py()
        linked, links = np.zeros((n, n), bool), np.zeros(n)
        for at in range(0, n, TILE):
            part = linked[at : at + TILE]
            np.greater_equal(x[at : at + TILE] @ x.T, threshold, out=part)
            if across:
                part &= block[at : at + TILE, None] != block[None, :]
            part[np.arange(len(part)), at + np.arange(len(part))] = False
        linked |= linked.T  # either side's rounding counts for both
        for at in range(0, n, TILE):
            links[at : at + TILE] = linked[at : at + TILE] @ copies
        root = roots_of(n, *forest(np.arange(n), lambda i, left: linked[i, left]))
        has, ids = np.flatnonzero(links > 0), table.column("id").combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(has)), ids.take(pa.array(root[has])), pa.array(links[has].astype(np.int64))], names=["id", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["grp", "bi", "bj", "dims"], 4096, 32 << 20):
            table = table.combine_chunks()
            start = np.flatnonzero(changes(table, ["grp", "bi", "bj", "dims"]))
            for k, n in zip(start.tolist(), np.diff(np.append(start, table.num_rows)).tolist()):
                if n > 1:
                    yield from one(table.slice(k, n))

    return run


def links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> (vec_id, n_links, component_id, kept), a row for each row of vectors.

    Two vectors are linked if they have as many components and their cosine in double precision is at least `threshold`. n_links counts the other rows linked
    directly, equal vectors included; component_id is the least vec_id that links reach, the row's own included; kept says whether that is the row's own.
    A vector that is null, empty, zero, or holds null or non-finite components links with nothing. Components of any finite size will do. Repeated rows and rows
    that share a vec_id count each. A row of null vec_id takes part but names no component (a component of such rows alone has none, and they are not kept).
    An empty table gives an empty one; other columns, whatever their names, are not read.

    Every vector goes to its own cell and to the PROBES nearest others of each table; a cell is as many E8 points as keep unrelated vectors apart, and as
    many tables are made as find pairs at the threshold with probability `recall`. Equal vectors are one node; sketches prune cells, and what passes is
    closed to groups, inside which all cosines are worked out, block against block: a group's links are all found once it holds together."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    signed = materialize(vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(_signed, f"vec_id {kind}, id binary, node long, unit binary"), "units")
    classes = signed.where("id is not null").groupBy("id").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("node").alias("node"), F.first("unit").alias("unit"))
    classes = materialize(classes, "classes")
    blocks = blocks_for(classes.count())
    cells = classes.select("node", "unit").mapInArrow(_cells(blocks, tables_for(blocks, threshold, recall)), CELLS_SCHEMA)
    edges = cells.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_links(most_bits(threshold) + ABSORBED), "a long, b long")
    groups = small_side(materialize(components(edges).withColumnRenamed("root", "grp"), "groups"))
    members = materialize(classes.join(groups, "node").select("grp", "id", "copies", "unit"), "members")
    sizes = members.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    sizes = small_side(materialize(sizes.where("n_blocks > 1"), "sizes"))
    m = members.join(sizes, "grp", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    m = m.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    m = m.select("grp", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), F.octet_length("unit").alias("dims"), "block", "id", "copies", "unit")
    keys = ["grp", "bi", "bj", "dims"]
    found = materialize(m.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(_verified(threshold), "id binary, root binary, links long"), "verified")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = classes.select("id", "rep", "copies").join(roots, "id", "left").join(counts, "id", "left")
    linked = materialize(linked.select("id", F.coalesce("root", "id").alias("root"), "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    named = linked.join(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("id", "n_links", "component_id")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = signed.select("vec_id", "id").join(named, "id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component among all vectors."""
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS r, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0
), l AS (
  SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), c AS (
  SELECT r AS x, r AS y FROM v UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y
), m AS (
  SELECT c.x, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.y GROUP BY c.x
), n AS (
  SELECT x, count(*) AS n FROM l GROUP BY x
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN m ON m.x = v.r LEFT JOIN n ON n.x = v.r
"""
