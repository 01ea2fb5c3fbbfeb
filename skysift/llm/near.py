"""Candidate groups and exact verification, shared by the operators on near-duplicate texts.

Texts that are equal form one node. Nodes whose signatures agree in a band meet in that band's bucket, and there pairs whose signatures differ too much are
dropped at once: what is left of a bucket goes on as a spanning forest, not as its pairs. The connected groups of these forests hold every candidate pair, so
all pairs of a group are judged inside vectorised kernels, block against block, and only a spanning forest and counts come out: no table ever has a row for
each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.graph import components, roots_of
from skysift.llm.storage import materialize
from skysift.llm.textkit import changes, utf8_buffers, whole_runs

#: Nodes of a group, and their text, that one kernel call compares with as many others.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: A shingle that a DENSE-th of the sets share is a column of a matrix, WIDTH columns at a time; of the others, about PAIRS pairs of sets are counted at a
#: time. Links are read off TILE rows at a time.
DENSE, WIDTH, PAIRS, TILE = 14, 2048, 1 << 20, 256
#: Groups of so many nodes are judged together; a place has four bits of a key.
SMALL = 8
#: A side is broadcast only if it has at most so many rows of a few numbers each; beyond that Spark shuffles both.
BROADCAST_ROWS = 400_000

BAND_SCHEMA = "key long, node long, edge boolean"
#: The same rows, many to a row: those of a batch whose keys fall to one part. A part has about PART of them, at least so many parts there are.
PACKED_SCHEMA, PART, PARTS = "part int, edge boolean, keys binary, nodes binary", 1 << 20, 256
#: Share of equal signature values from which a member is nearly its bucket's first one; members of a bucket that are compared all with all; and the
#: probability of a link below which a pair is dropped.
ABSORBED, BUCKET, TOLERANCE = 0.95, 8192, 1e-6


def least_matches(values: int, threshold: float, tolerance: float, step: int) -> list[tuple[int, int]]:
    """(values compared, least matches to go on): below it, with a uniform prior, P(similarity >= threshold | matches) < tolerance.

    The posterior is Beta(m + 1, n - m + 1), and P(>= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(step, values + 1, step):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append((n, m))
    return out


def small_side(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its counted rows are few. df should be materialised."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def band_batch(nodes: np.ndarray, keys: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    """Rows for candidate_groups: within the batch, a member of a bucket whose signature is nearly that of the bucket's first one is linked to it and goes
    no further (the map-side combine); all others go on."""
    flat = keys.ravel()
    at = np.repeat(np.arange(len(nodes)), keys.shape[1])
    order = np.lexsort((at, flat))
    flat, at = flat[order], at[order]
    head = np.ones(len(flat), bool)
    head[1:] = flat[1:] != flat[:-1]
    hub = at[np.maximum.accumulate(np.where(head, np.arange(len(flat)), 0))] if len(flat) else at
    link = np.flatnonzero(~head & (nodes[at] != nodes[hub]))
    twin = np.flatnonzero(~head & (nodes[at] == nodes[hub]))
    close = link[(sig[at[link]] == sig[hub[link]]).sum(1) >= ABSORBED * sig.shape[1]]
    stays = np.ones(len(flat), bool)
    stays[close] = stays[twin] = False
    pairs = np.unique(np.stack([nodes[at[close]], nodes[hub[close]]], 1), axis=0) if len(close) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([flat[stays], pairs[:, 0]])),
            pa.array(np.concatenate([nodes[at[stays]], pairs[:, 1]])),
            pa.array(np.concatenate([np.zeros(int(stays.sum()), bool), np.ones(len(pairs), bool)])),
        ],
        names=["key", "node", "edge"],
    )


def packed(rows: pa.RecordBatch, parts: int) -> pa.RecordBatch:
    """band_batch's rows in PACKED_SCHEMA: Spark shuffles and sorts a few hundred rows a batch, not one for each band of each node."""
    key, node, edge = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    part = (key.view(np.uint64) % np.uint64(parts)).astype(np.int64) * 2 + edge
    order = np.argsort(part, kind="stable")
    part = part[order]
    head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = pa.py_buffer((np.append(head, len(part)) * 8).astype(np.int32).tobytes())
    blobs = [pa.Array.from_buffers(pa.binary(), len(head), [None, ends, pa.py_buffer(x[order].tobytes())]) for x in (key, node)]
    return pa.RecordBatch.from_arrays([pa.array((part[head] >> 1).astype(np.int32)), pa.array((part[head] & 1).astype(bool)), *blobs], names=["part", "edge", "keys", "nodes"])


def packer(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, which gives about so many rows of BAND_SCHEMA in all, with its rows packed."""
    parts = max(PARTS, rows // PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel(batches):
            yield packed(batch, parts)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows sorted by part: each part's band rows, sorted by (key, node)."""
    for table in whole_runs(batches, ["part"], 1 << 16, 8 << 20):
        edge = table.column("edge").combine_chunks().to_numpy(zero_copy_only=False)
        for ready in (True, False):
            some = table.filter(pa.array(edge == ready))
            key, node = (np.frombuffer(utf8_buffers(some.column(c).cast(pa.large_binary()))[0].tobytes(), np.int64) for c in ("keys", "nodes"))
            order = np.arange(len(key)) if ready else np.lexsort((node, key))
            yield pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(node[order]), pa.array(np.full(len(key), ready))], names=["key", "node", "edge"])


def _shared_of_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _shared(_unpacked(batches))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: the members of buckets that have two or more, and the edges that come ready; a batch's repeats of a member go.

    Nodes are sorted here, batch by batch: by one number alone Spark sorts several times faster. A bucket's members past the first BUCKET become edges to its first one, unpruned, so that no candidate is lost and no task holds more."""
    key_, node_, hub_, rank_, sent = None, None, None, 0, False  # the member before: its bucket, itself, the bucket's first, its place there, and whether it went out
    for batch in batches:
        key, node, edge = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        out = [(key[edge], node[edge], np.ones(int(edge.sum()), bool))]
        key, node = key[~edge], node[~edge]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        if len(key):
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            new[0] = key_ is None or key[0] != key_ or node[0] != node_
        key, node = key[new], node[new]
        if len(key):
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            goes_on = key_ is not None and key[0] == key_
            head[0] = not goes_on
            first = np.maximum.accumulate(np.where(head, np.arange(len(key)), -1))
            rank = np.arange(len(key)) - np.where(first >= 0, first, -1 - rank_)
            hub = np.where(first >= 0, node[np.maximum(first, 0)], hub_ if goes_on else 0)
            with_next = np.zeros(len(key), bool)
            with_next[:-1] = ~head[1:]
            keep = ~head | with_next
            if goes_on and not sent:
                out.append((np.array([key_]), np.array([node_]), np.zeros(1, bool)))
            late = keep & (rank >= BUCKET)
            own = keep & ~late
            out += [(key[own], node[own], np.zeros(int(own.sum()), bool)), (node[late], hub[late], np.ones(int(late.sum()), bool))]
            key_, node_, hub_, rank_, sent = key[-1], node[-1], hub[-1], int(rank[-1]), bool(keep[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["key", "node", "edge"])


def forest(sig: np.ndarray, passes: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of rows that pass: rows are reached from one another, and what is reached is compared no more."""
    left = np.arange(len(sig))
    a, b = [], []
    reached: list[int] = []
    while len(left):
        if not reached:
            i, left = int(left[0]), left[1:]
        else:
            i = reached.pop()
        hit = passes(sig[i], sig[left])
        found = left[hit]
        a.append(found)
        b.append(np.full(len(found), i))
        reached += found.tolist()
        left = left[~hit]
    return np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)


def _forests(passes: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (key, node, sig) sorted by key: the edges of each bucket's forest; buckets of two are judged together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["key"], BUCKET, 64 << 20):
            key, node = (table.column(c).combine_chunks().to_numpy() for c in ("key", "node"))
            sig = np.frombuffer(utf8_buffers(table.column("sig"))[0].tobytes(), np.uint16).reshape(len(key), -1)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(key)))
            two = start[size == 2]
            two = two[passes(sig[two], sig[two + 1])] if len(two) else two
            a, b = [node[two + 1]], [node[two]]
            for i, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                x, y = forest(sig[i : i + n], passes)
                a.append(node[i + x])
                b.append(node[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def candidate_groups(bands: DataFrame, signatures: DataFrame, values: int, threshold: float, tolerance: float = TOLERANCE) -> DataFrame:
    """bands (key, node, edge) or packed ones, signatures (node, sig) of so many values -> (node, grp): groups of two nodes or more.

    In a bucket two members pass unless the posterior probability that their similarity reaches `threshold` less a tenth is under `tolerance`; the tenth
    makes up for members that stand for nearly equal ones. Signatures travel only with members of buckets that several share."""
    least = least_matches(values, threshold - 0.1, tolerance, values)[-1][1]
    passes = lambda x, y: (x == y).sum(-1) >= least
    by, kernel = ("part", _shared_of_packed) if "part" in bands.columns else ("key", _shared)
    shared = materialize(bands.repartition(by).sortWithinPartitions(by).mapInArrow(kernel, BAND_SCHEMA), "shared")
    ready = shared.where("edge").select(F.col("key").alias("a"), F.col("node").alias("b"))
    met = shared.where("not edge").select("key", "node")
    wanted = small_side(materialize(met.select("node").distinct(), "wanted"))
    sig = signatures.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    edges = met.join(sig, "node").repartition("key").sortWithinPartitions("key").mapInArrow(_forests(passes), "a long, b long")
    # written, as components() begins with a kernel too: two in one stage take two Python workers for each task, and executors keep them all
    edges = materialize(edges, "forests")
    return materialize(components(ready.unionByName(edges)).withColumnRenamed("root", "grp"), "groups")


def block_pairs(members: DataFrame, slim: DataFrame) -> DataFrame:
    """members (grp, id, ...), slim (grp, bytes) with a row for each -> a row (grp, bi, bj, block, id, ...) for each pair of blocks of its group that a
    member takes part in. A block has about BLOCK members, and BLOCK_BYTES of text."""
    sizes = slim.groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    sizes = small_side(materialize(sizes.where("n_blocks > 1"), "sizes"))
    m = members.join(sizes, "grp", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    m = m.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks").cast("long")).cast("int"))
    m = m.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return m.withColumns({"bi": F.least("block", "_other"), "bj": F.greatest("block", "_other")}).drop("_other", "n_blocks")


def _added(out: np.ndarray, row: np.ndarray, first: np.ndarray, run: np.ndarray, half: int | None) -> None:
    """Adds one to out[x, y] for each two rows of a column; columns are runs of `row`. With `half`, x is a row under it and y one from it on."""
    ends = np.cumsum(run * (run - 1) // 2)
    at = 0
    while at < len(run):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        x, y = _all_pairs(run[at:to], first[at:to])
        x, y = row[x], row[y]
        if half is not None:
            over = (x < half) & (y >= half)
            x, y = x[over], y[over] - half
        cell, n = np.unique(x * out.shape[1] + y, return_counts=True)
        out.ravel()[cell] += n
        at = to


def intersections(shingles: np.ndarray, ends: np.ndarray, half: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the distinct shingle sets, and the sizes of their intersections: of x with y at [x, y], x < y, or of the rows under `half` with those from it on.

    Shingles that many sets share are counted by matrix products, the others by their pairs of sets: near copies share what they are copies of, and each has
    changes of its own, which would make the matrices wide."""
    n = len(ends) - 1
    doc = np.repeat(np.arange(n), np.diff(ends))
    order = np.argsort(shingles, kind="stable")
    s, d = shingles[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    sizes = np.bincount(d, minlength=n)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    run = np.diff(np.append(first, len(s)))
    ok = run > 1
    if half is not None and len(run):  # the rows of a run ascend
        ok &= (d[first] < half) & (d[first + run - 1] >= half)
    first, run = first[ok], run[ok]
    out = np.zeros((n, n) if half is None else (half, n - half), np.float32)
    wide = run * DENSE >= n
    _added(out, d, first[~wide], run[~wide], half)
    first, run = first[wide], run[wide]
    for at in range(0, len(run), WIDTH):
        size = run[at : at + WIDTH]
        where = np.arange(int(size.sum())) + np.repeat(first[at : at + WIDTH] - (np.cumsum(size) - size), size)
        m = np.zeros((n, len(size)), np.float32)
        m[d[where], np.repeat(np.arange(len(size)), size)] = 1
        out += m @ m.T if half is None else m[:half] @ m[half:].T
    return sizes, out


VERIFIED_SCHEMA = "id binary, root binary, links long"
Shingler = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]
Pruner = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _all_pairs(size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), i < j, of all pairs inside groups of consecutive rows."""
    row = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    after = np.repeat(start + size, size) - row - 1
    i = np.repeat(row, after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def _common(shingles: np.ndarray, ends: np.ndarray, group: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the distinct shingle sets, and of the intersections of the pairs (i, j) inside small groups, by one sort over all of them.

    A key has 12 bits of group, 48 of shingle and 4 of place."""
    n = len(group)
    row = np.repeat((group.astype(np.uint64) << np.uint64(52)) | place.astype(np.uint64), np.diff(ends))
    key = np.sort(row | ((shingles >> np.uint64(16)) << np.uint64(4)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    base = np.zeros(int(group.max()) + 1, np.int64)
    base[group[::-1]] = np.arange(n)[::-1]
    owner = base[(key >> np.uint64(52)).astype(np.int64)] + (key & np.uint64(15)).astype(np.int64)
    sizes = np.bincount(owner, minlength=n)
    what = key >> np.uint64(4)
    first = np.flatnonzero(np.concatenate([[True], what[1:] != what[:-1]])) if len(what) else np.zeros(0, np.int64)
    run = np.diff(np.append(first, len(what)))
    x, y = _all_pairs(run[run > 1], first[run > 1])
    counts = np.bincount(owner[x] * SMALL + (owner[y] - owner[x]), minlength=n * SMALL)
    return sizes, counts[i * SMALL + (j - i)]


def verifier(shingle: Shingler, threshold: float, prune: Pruner | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel over rows (grp, bi, bj, block, id, copies, ...) sorted by (grp, bi, bj, id).

    Per id and block pair: the first id of its component there, and the documents linked to it (partners' copies). Small groups are judged many at a
    time, without the pairs that `prune` drops; large ones by counts of all their intersections, block against block."""

    def similar(x: np.ndarray, y: np.ndarray, inter: np.ndarray) -> np.ndarray:
        inter = inter.astype(np.float64)
        return (inter > 0) & (inter >= threshold * (x + y - inter) - 1e-9)

    def judged(table: pa.Table, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified pairs of the small groups at start."""
        i, j = _all_pairs(size, start)
        block = table.column("block").to_numpy()
        across = (table.column("bi").to_numpy() != table.column("bj").to_numpy())[i]
        left = np.flatnonzero(~across | (block[i] != block[j]))
        i, j = i[left], j[left]
        if prune is not None and len(i):
            sig = utf8_buffers(table.column("sig"))[0].tobytes()
            left = prune(np.frombuffer(sig, np.uint16).reshape(table.num_rows, -1), i, j)
            i, j = i[left], j[left]
        if not len(i):
            return i, j
        used = np.unique(np.concatenate([i, j]))
        at = np.zeros(table.num_rows, np.int64)
        at[used] = np.arange(len(used))
        shingles, ends = shingle(table.take(pa.array(used)))
        x, y = at[i], at[j]
        group = np.repeat(np.arange(len(size)), size)
        where = np.zeros(table.num_rows, np.int64)
        where[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)] = group
        g = where[used]
        head = np.concatenate([[True], g[1:] != g[:-1]])
        place = np.arange(len(g)) - np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
        sizes, inter = _common(shingles, ends, np.cumsum(head) - 1, place, x, y)
        yes = similar(sizes[x], sizes[y], inter)
        return i[yes], j[yes]

    def crowd(table: pa.Table, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one large group: each row's links, and a spanning forest of its verified pairs."""
        n, block = table.num_rows, table.column("block").to_numpy()
        across = table.column("bi")[0].as_py() != table.column("bj")[0].as_py()
        order = np.argsort(block, kind="stable") if across else np.arange(n)
        half = int((block == block.min()).sum()) if across else None
        links = np.zeros(n)
        if half == n:
            return links, np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes, inter = intersections(*shingle(table.take(pa.array(order))), half)
        low, col = (n, 0) if half is None else (half, half)
        linked = np.zeros((n, n), bool)
        for at in range(0, low, TILE):
            to = min(at + TILE, low)
            linked[at:to, col:] = similar(sizes[at:to, None], sizes[None, col:], inter[at:to])
        if half is None:
            linked = np.triu(linked, 1)
        linked |= linked.T
        for at in range(0, n, TILE):
            links[order[at : at + TILE]] = linked[at : at + TILE] @ copies[order]
        a, b = forest(np.arange(n), lambda i, left: linked[i, left])
        return links, order[a], order[b]

    def one(table: pa.Table, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        copies = table.column("copies").to_numpy().astype(np.float64)
        links = np.zeros(table.num_rows)
        edges = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        small = (size > 1) & (size <= SMALL)
        for at in range(0, int(small.sum()), 4096):
            i, j = judged(table, start[small][at : at + 4096], size[small][at : at + 4096])
            links += np.bincount(i, copies[j], table.num_rows) + np.bincount(j, copies[i], table.num_rows)
            edges.append((i, j))
        for a, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
            links[a : a + n], i, j = crowd(table.slice(a, n), copies[a : a + n])
            edges.append((i + a, j + a))
        i, j = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
        if not len(i):
            return
        root = roots_of(table.num_rows, i, j)
        linked = np.flatnonzero(links > 0)
        ids = table.column("id").combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(linked)), ids.take(pa.array(root[linked])), pa.array(links[linked].astype(np.int64))], names=["id", "root", "links"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["grp", "bi", "bj"], 4096, 2 << 20):
            change = changes(table, ["grp", "bi", "bj"])
            again = ~changes(table, ["grp", "bi", "bj", "id"])
            if again.any():  # a repeated row of one id
                table, change = table.filter(pa.array(~again)), change[~again]
            start = np.flatnonzero(change)
            yield from one(table.combine_chunks(), start, np.diff(np.append(start, table.num_rows)))

    return kernel


def verified(members: DataFrame, slim: DataFrame, kernel: Callable, counted: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """members (grp, id, copies, ...), slim (grp, bytes) -> (id, root) of verified components, and (id, links) if they are counted."""
    keys = ["grp", "bi", "bj"]
    found = materialize(block_pairs(members, slim).repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(kernel, VERIFIED_SCHEMA), "verified")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    return roots, found.groupBy("id").agg(F.sum("links").alias("links")) if counted else None
