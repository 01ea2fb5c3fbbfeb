"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, packing. Each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import line_dedup, mixing, ngram_join, packing, quality
from skysift.llm.storage import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1. Null and empty texts fail it (few words); repeated rows pass or fail alike. An empty table gives an empty one."""
    return quality.ledger(docs).where(quality.passes("v1")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; n_chars follows. A document of which no word is left goes: all its lines are kept elsewhere.

    Null and empty texts, which have no lines to lose, stay as they are. Rows that agree in doc_id and text keep the same lines, so none loses them to its
    twin; of near lines the first by (doc_id, text hash, line number) stays, null doc_ids first. An empty table gives an empty one."""
    left = line_dedup.dedup(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", changed).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the one of the least doc_id, null first, then of the least text hash.

    Texts without words, null ones too, are copies of each other. Repeated rows leave one. An empty table gives an empty one."""
    return ngram_join.survivors(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in the order of its shards.

    Null and empty texts have no words and are taken as their block falls. Rows of equal doc_id, and equal rows, count each; ties are settled by a hash of
    doc_id. A null source is one. An empty table gives an empty one."""
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens.

    Every row is packed, repeated ones and those of null or equal doc_id too; a null or empty text is one closing token. An empty table gives an empty one."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenization and the genetic algorithm are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
