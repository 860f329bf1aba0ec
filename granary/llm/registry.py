"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, flac, language_id, line_dedup, mixing, ngram_join, packing, pii, quality, topk_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": ngram_join.query,
        "op2_chat_formatting": chat_format.query,
        "op3_temperature_mixing": mixing.query,
        "op4_fuzzy_line_dedup": line_dedup.query,
        "op5_best_fit_packing": packing.query,
        "op6_quality_discriminant": quality.query,
        "op7_pii_anchor_expansion": pii.query,
        "op8_exact_topk_search": topk_search.query,
        "op9_flac_media_columns": flac.query,
        "op10_byte_gru_language_id": language_id.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op8_exact_topk_search": topk_search.ORACLE}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
