"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import byte_bpe, chat, flac, licenses, line_dedup, mixing, near_dedup, quality, sql, substring_dedup, url_filter

_QUERIES = (
    substring_dedup.op1_substring_dedup,
    byte_bpe.op2_byte_bpe,
    url_filter.op3_url_filter,
    flac.op4_flac_media,
    licenses.op5_license_scan,
    chat.op6_chat_tree,
    line_dedup.op7_line_dedup,
    quality.op8_quality_rules,
    mixing.op9_source_mixing,
    near_dedup.op10_near_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
