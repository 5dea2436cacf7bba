"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, digest, divergence, langid, lines, packing, pii, quality, search, simhash, streaming_viterbi, substring, tokenstore


def _over(table: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": _over("documents", substring.query),
    "op2_chat": _over("conversations", chat.query),
    "op3_tokenstore": _over("documents", tokenstore.query),
    "op4_langid": _over("documents", langid.query),
    "op5_pii": _over("documents", pii.query),
    "op6_sentencepiece": _over("documents", streaming_viterbi.query),
    "op7_simhash": _over("documents", simhash.query),
    "op8_digest": _over("documents", digest.query),
    "op9_packing": _over("documents", packing.query),
    "op10_quality": lambda spark, sf_dir: quality.query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op11_divergence": _over("documents", divergence.query),
    "op12_lines": _over("documents", lines.query),
    "op13_search": lambda spark, sf_dir: search.query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    # the part of operator 10 that SQL can express, by itself
    "quality_base_rules": _over("documents", quality.base_rules),
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring.ORACLE, "op2_chat": chat.ORACLE, "op11_divergence": divergence.ORACLE, "op12_lines": lines.ORACLE, "op13_search": search.ORACLE, "quality_base_rules": quality.BASE_ORACLE,
}
