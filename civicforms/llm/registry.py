"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civicforms.llm import (
    ball_codes, bpe, chat, exact_dedup, filter_audit, fingerprints, langid, license_scan, lm_score, ngram_join, packing, token_output, toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_packing": packing.op2_packing,
        "op3_fingerprints": fingerprints.op3_fingerprints,
        "op4_language_id": langid.op4_language_id,
        "op5_chat_format": chat.op5_chat_format,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_token_output": token_output.op7_token_output,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_license_scan": license_scan.op12_license_scan,
        "op13_ball_codes": ball_codes.op13_ball_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_format": chat.ORACLE,
        "op8_lm_score": lm_score.ORACLE,
        "op9_ngram_join": ngram_join.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op12_license_scan": license_scan.ORACLE,
        "op13_ball_codes": ball_codes.ORACLE,
    }
