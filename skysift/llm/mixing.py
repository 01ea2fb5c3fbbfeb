"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree over source blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysift.llm.near import small_side
from skysift.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2.0
SHARDS = 16
#: Rounds in which each source may add or give back one document to come nearer to its target.
SETTLING = 4
SEED = 20240229
MOST_BROADCAST = 50_000
#: Copies of one row that a task makes at a time, and rows that a piece of an output shard holds, about.
COPIES, PIECE = 1000, 1000


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST_TIMES) -> list[float]:
    """Shares of total by weight, none above `most` times its source's size; the excess goes to the others by weight until none is above."""
    out = [0.0] * len(sizes)
    left, free = total, set(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free -= over
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): exact integer quotas, split in halves by multivariate hypergeometric draws down to the shards."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, np.array(quotas, np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        total = int(q.sum())
        take = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(q, take, method="marginals") if total else q
        stack += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _side(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row per source; broadcast if the sources are no more than MOST_BROADCAST."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= MOST_BROADCAST else df


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, text, ...) -> (row_id, row_key, doc_id, source, size, source_size, target, copies, shards), a row for each row of docs.

    size: words of the text (null: 0). Sources, sorted by code point with null last, weigh `weights` in turn and share `share` times all sizes (see
    targets). A source's documents fall by hash into about sqrt(n) blocks, which a seeded permutation puts in order; the quota is whole passes over the
    blocks, then whole blocks in that order, then documents of the boundary block; at last up to four documents are added or given back, each
    the one that brings the sum nearest to the target. copies: 0, 1 or 2; shards: the output shard of each copy. row_key: a hash of all columns, by which
    mix() finds the row again. Rows of equal doc_id, and equal rows, are separate documents. An empty table gives an empty one; extra columns of any
    name only enter row_key. The driver holds a few numbers for each source and shard, nothing for each document."""
    spark = docs.sparkSession
    sized = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"), row_key(docs).alias("row_key"), "doc_id", "source",
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("h"),
        ), "sized",
    )
    rows = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["words"]) for r in rows]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(rows))], share * sum(sizes))
    whole = [min(int(MOST_TIMES), math.floor(t / s + 1e-12)) if s else 0 for t, s in zip(goal, sizes)]
    table = [(r["source"], i, s, float(t), k, max(0.0, t - k * s), max(1, math.isqrt(int(r["n"])))) for i, (r, s, t, k) in enumerate(zip(rows, sizes, goal, whole))]
    names = "source string, sid int, source_size long, target double, passes int, rest double, n_blocks long"
    sources = _side(spark, table, names).withColumnRenamed("source", "__sky_source")
    d = sized.join(sources, sized["source"].eqNullSafe(sources["__sky_source"])).withColumn("block", F.pmod("h", "n_blocks"))
    order = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "sid", "block"), "block")
    blocks = d.groupBy("sid", "block", "rest").agg(F.sum("size").alias("w"))
    blocks = blocks.withColumns({"turn": F.row_number().over(order) - 1, "upto": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    blocks = materialize(blocks, "blocks")
    edge = blocks.where("upto > rest").groupBy("sid").agg(F.min(F.struct(F.col("turn").alias("block"), (F.col("upto") - F.col("w")).alias("before"))).alias("e"))
    d = d.join(small_side(blocks.select("sid", "block", "turn")), ["sid", "block"]).drop("block").withColumnRenamed("turn", "block")
    edges = [(r["sid"], r["e"]["block"], float(r["e"]["before"])) for r in edge.collect()]
    bound = _side(spark, edges, "sid int, edge long, before double")
    d = d.join(bound, "sid", "left")
    inside = Window.partitionBy("sid").orderBy("h", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = d.where("block = edge").withColumn("extra", (F.col("before") + F.sum("size").over(inside) <= F.col("rest")).cast("int"))
    others = d.where("edge is null or block <> edge").withColumn("extra", F.when(F.col("edge").isNotNull() & (F.col("block") < F.col("edge")), 1).otherwise(0))
    chosen = materialize(cut.unionByName(others).withColumn("extra", F.when(F.col("passes") >= MOST_TIMES, 0).otherwise(F.col("extra"))), "chosen")
    gaps = {r["sid"]: float(r["gap"]) for r in chosen.groupBy("sid").agg((F.first("rest") - F.sum(F.col("size") * F.col("extra"))).alias("gap")).collect()}
    turned: list[tuple] = []
    for _ in range(SETTLING):
        swaps = _side(spark, [(r,) for r in turned], "turned_row long")
        now = chosen.join(swaps, chosen["row_id"] == swaps["turned_row"], "left").withColumn("extra", F.when(F.col("turned_row").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra")))
        gap = _side(spark, sorted(gaps.items()), "sid int, gap double")
        step = F.when(F.col("extra") == 0, F.col("size")).otherwise(-F.col("size"))
        off = F.abs(F.col("gap") - step)
        best = now.where(F.col("turned_row").isNull() & (F.col("passes") < MOST_TIMES)).join(gap, "sid").where(off < F.abs("gap"))
        best = best.groupBy("sid").agg(F.min(F.struct(off.alias("off"), "h", "doc_id", "row_id", step.alias("step"))).alias("b")).collect()
        if not best:
            break
        turned += [r["b"]["row_id"] for r in best]
        gaps |= {r["sid"]: gaps[r["sid"]] - r["b"]["step"] for r in best}
    swaps = _side(spark, [(r,) for r in turned], "turned_row long")
    chosen = chosen.join(swaps, chosen["row_id"] == swaps["turned_row"], "left").withColumn("extra", F.when(F.col("turned_row").isNotNull(), 1 - F.col("extra")).otherwise(F.col("extra"))).drop("turned_row")
    where = {sid: e for sid, e, _ in edges}
    quota = [r[4] * r[6] + (where.get(r[1], 0) + 1 if r[5] > 0 else 0) for r in table]
    ends = np.cumsum(split_quotas(quota, shards, seed), axis=0) if table else np.zeros((shards, 0), np.int64)
    lanes = _side(spark, [(i, ends[:, i].tolist()) for i in range(len(table))], "sid int, ends array<long>")
    chosen = chosen.join(lanes, "sid").withColumn("copies", F.col("passes") + F.col("extra"))
    slot = lambda k: F.least(F.size(F.filter("ends", lambda e: e <= F.col("block") + k * F.col("n_blocks"))), F.lit(shards - 1))
    places = F.transform(F.sequence(F.lit(1), F.lit(int(MOST_TIMES))), lambda k: F.when(k <= F.col("copies"), slot((k - 1).cast("long"))))
    return chosen.select("row_id", "row_key", "doc_id", "source", "size", "source_size", "target", "copies", F.array_compact(places).alias("shards"))


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns and of which are null; equal rows share it."""
    nulls = [F.col(f"`{f.name}`").isNull() for f in docs.schema]
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*plain, *nulls)


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs -> its rows as often as plan() takes them, with shard (int), shuffled by a seeded hash within each piece of a shard.

    Every row counts by itself, rows of equal doc_id too; of equal rows one stands for all and is written as often as they are taken together. A column
    named shard is replaced; names that begin with __sky are reserved. An empty table gives an empty one."""
    seed = options.get("seed", SEED)
    docs = docs.drop("shard")
    p = plan(docs, **options).select(F.col("row_key").alias("__sky_key"), "shards", "copies")
    rows = materialize(p.groupBy("__sky_key").agg(F.count("*").alias("n"), F.sum("copies").alias("taken")).where("taken > 0"), "taken_rows")
    several = small_side(materialize(rows.where("n > 1").select("__sky_key"), "several"))
    taken = p.select("__sky_key", F.explode("shards").alias("shard")).groupBy("__sky_key", "shard").agg(F.count("*").alias("n"))
    lots = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("__sky_lot")
    taken = taken.select("__sky_key", "shard", "n", lots).withColumn("__sky_n", F.least(F.lit(COPIES), F.col("n") - F.col("__sky_lot") * COPIES).cast("int")).drop("n")
    taken = small_side(materialize(taken, "taken"))
    d = docs.withColumn("__sky_key", row_key(docs))
    once = d.join(several, "__sky_key", "left_anti").unionByName(d.join(several, "__sky_key", "left_semi").dropDuplicates(["__sky_key"]))
    out = once.join(taken, "__sky_key").withColumn("__sky_copy", F.explode(F.sequence(F.lit(1), F.col("__sky_n"))))
    out = out.withColumn("__sky_h", F.xxhash64(F.lit(seed), "__sky_key", "shard", "__sky_lot", "__sky_copy"))
    pieces = max(1, -(-int(rows.agg(F.sum("taken")).first()[0] or 0) // (options.get("shards", SHARDS) * PIECE)))
    out = out.repartition("shard", F.pmod("__sky_h", F.lit(pieces))).sortWithinPartitions("shard", "__sky_h")
    return out.select(*docs.columns, "shard")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    p = plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "shards")
