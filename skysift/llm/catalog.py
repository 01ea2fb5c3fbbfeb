"""Queries and DuckDB oracles of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skysift.llm import chat, embedding_dedup, line_dedup, mixing, ngram_join, packing, quality, secrets_scan, spelling, topk, toxicity, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_url_filter": urls.op2_url_filter,
    "op3_mixing": mixing.op3_mixing,
    "op4_secret_scan": secrets_scan.op4_secret_scan,
    "op5_topk_search": topk.op5_topk_search,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_embedding_dedup": embedding_dedup.op12_embedding_dedup,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat.ORACLE, "op5_topk_search": topk.ORACLE, "op8_ngram_join": ngram_join.ORACLE, "op9_quality_rules": quality.ORACLE, "op10_line_dedup": line_dedup.ORACLE,
    "op11_spelling_variants": spelling.ORACLE, "op12_embedding_dedup": embedding_dedup.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
