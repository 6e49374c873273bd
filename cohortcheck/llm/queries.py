"""The registered queries of this folder, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortcheck.llm import (
    audit,
    bpe,
    licenses,
    mixing,
    neardup,
    quality,
    resampling,
    rules,
    sharding,
    tokens,
    toxicity,
    urls,
    vectors,
)

OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_quality": quality.op2_quality,
    "op3_neardup": neardup.op3_neardup,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_bpe": bpe.op5_bpe,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_mixing": mixing.op7_mixing,
    "op8_url_filter": urls.op8_url_filter,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_embedding_dedup": vectors.op10_embedding_dedup,
    "op11_resampling": resampling.op11_resampling,
    "op12_sharding": sharding.op12_sharding,
    "op13_filter_audit": audit.op13_filter_audit,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(OPERATORS)


def oracle_sql() -> dict[str, str]:
    return {**rules.SQL, **licenses.SQL, **mixing.SQL, **urls.SQL, **resampling.SQL, **audit.SQL, **sharding.SQL}
