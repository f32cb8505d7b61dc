"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, divergence, jaccard, languages, lexical, neardup_vectors, packing, pages, quality, secrets, sharding, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_embedding_neardup": neardup_vectors.op2_embedding_neardup,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_quality": quality.op4_quality,
        "op5_jaccard_join": jaccard.op5_jaccard_join,
        "op6_language_id": languages.op6_language_id,
        "op7_html_extraction": pages.op7_html_extraction,
        "op8_packing": packing.op8_packing,
        "op9_secret_scan": secrets.op9_secret_scan,
        "op10_exact_topk": topk.op10_exact_topk,
        "op11_ranked_search": lexical.op11_ranked_search,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_topk": topk.OP10_SQL,
        "op11_ranked_search": lexical.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
        "op13_sharding": sharding.OP13_SQL,
    }
