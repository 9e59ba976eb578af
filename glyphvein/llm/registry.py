"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphvein.llm import alignment, bpe, chunkreuse, infill, jaccard, mixing, neighbours, quality, scoring, secrets, sql, substring, tokenfile, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_embeddings": neighbours.op2_embeddings,
        "op3_secrets": secrets.op3_secrets,
        "op4_substring": substring.op4_substring,
        "op5_quality": quality.op5_quality,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_scores": scoring.op9_scores,
        "op10_token_file": tokenfile.op10_token_file,
        "op11_chunk_reuse": chunkreuse.op11_chunk_reuse,
        "op12_alignment": alignment.op12_alignment,
        "op13_infill": infill.op13_infill,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_embeddings": sql.EMBEDDINGS, "op4_substring": sql.SUBSTRING, "op8_jaccard": sql.JACCARD}
