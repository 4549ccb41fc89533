"""The queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import byte_bpe, embeddings, line_dedup, minhash, mixing, pii, quality, toxicity, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_url_filters": urls.op2_url_filters,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_mixing": mixing.op6_mixing,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_token_counts": byte_bpe.op8_token_counts,
        "op9_embeddings": embeddings.op9_embeddings,
        "op10_minhash": minhash.op10_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {}
