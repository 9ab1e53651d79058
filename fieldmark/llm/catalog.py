"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cross_tokenizer, language_id, mixing, ngram_join, oracle, packing, projected_neighbours, secret_scan, sharding, spot_signatures, substring_dedup, toxicity, url_rules, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_projected_neighbours": projected_neighbours.op1_projected_neighbours,
        "op2_spot_signatures": spot_signatures.op2_spot_signatures,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_packing": packing.op4_packing,
        "op5_language_id": language_id.op5_language_id,
        "op6_mixing": mixing.op6_mixing,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_sharding": sharding.op10_sharding,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_cross_tokenizer": cross_tokenizer.op12_cross_tokenizer,
        "op13_url_rules": url_rules.op13_url_rules,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
