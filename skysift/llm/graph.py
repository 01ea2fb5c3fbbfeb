"""Distributed union-find: connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.storage import discard, materialize

#: Edges that a task contracts at a time.
CHUNK = 100_000
#: Below so many edges each star's table of centres is broadcast: two short values a row.
BROADCAST_EDGES = 400_000


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each node's component; nodes are 0..n-1, edges (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def _forest(a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.RecordBatch:
    """A spanning forest of stars: (node, least node of its component among these edges)."""
    codes = pa.chunked_array([*a.chunks, *b.chunks]).combine_chunks().dictionary_encode()
    values = codes.dictionary
    order = pc.sort_indices(values).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[codes.indices.to_numpy()]
    root = roots_of(len(order), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(root != np.arange(len(order)))
    ordered = values.take(pa.array(order))
    return pa.RecordBatch.from_arrays([ordered.take(pa.array(moved)), ordered.take(pa.array(root[moved]))], names=["a", "b"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            t = pa.Table.from_batches(held)
            yield _forest(t.column("a"), t.column("b"))
            held, rows = [], 0
    if rows:
        t = pa.Table.from_batches(held)
        yield _forest(t.column("a"), t.column("b"))


def _star(edges: DataFrame, few: bool, large: bool) -> DataFrame:
    """One star operation on (a, b), a > b. The least neighbours are summed up map-side first; the rows then meet them by broadcast, or by a join whose
    crowded partitions Spark splits: the centres' table is written first, so that no aggregation holds a centre's rows together."""
    rows = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = rows.groupBy("a").agg((F.least(F.min("b"), F.col("a")) if large else F.min("b")).alias("low"))
    low = F.broadcast(low) if few else materialize(low, "centres")
    met = rows.join(low, "a")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return met.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Every node hangs on one other, on which the others of its component hang too: no end is the beginning of another edge."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up")))
    g = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not g.where("ups > 1 or (ups = 1 and least = 0)").limit(1).count()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges (a, b) -> (node, root), root being the least node of the component.

    Nodes are of any type with an order. Self loops and repeated edges are ignored; null ends are dropped. An empty table gives an empty one.
    Tasks contract their own edges first; what is left is contracted by one task if it is no more than CHUNK edges, else by rounds of stars.
    Every round is written to the shared folder, so neither lineage nor the driver's memory grows with the graph."""
    kind = edges.schema["a"].dataType.simpleString()
    contracted = lambda e: e.mapInArrow(_contract, f"a {kind}, b {kind}")
    e = materialize(contracted(edges.where("a <> b").select("a", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        n = e.count()
        if n <= CHUNK:
            e = materialize(contracted(e.coalesce(1)), "contracted")
            break
        if _settled(e):
            break
        few = n <= BROADCAST_EDGES
        wide = _star(e, few, True)
        wide = wide if few else materialize(wide.distinct(), "wide")
        old, e = e, materialize(_star(wide, few, False).where("a <> b").distinct(), "stars")
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
