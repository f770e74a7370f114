"""The training-data queries, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, extract, lm_score, mixing, quality, repeats, simhash, token_counts, topk, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_repeated_substrings": repeats.op2_repeated_substrings,
        "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
        "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_lm_score": lm_score.op6_lm_score,
        "op7_main_text": extract.op7_main_text,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_quality_votes": quality.op9_quality_votes,
        "op10_exact_top_k": topk.op10_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_decontamination": decontaminate.OP3_SQL,
        "op5_url_filter": url_filter.OP5_SQL,
        "op8_mix_sources": mixing.OP8_SQL,
        "op10_exact_top_k": topk.OP10_SQL,
    }
