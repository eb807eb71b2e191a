"""The queries of this subpackage and, where SQL can express one, the DuckDB statement for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op3_line_dedup, op4_chat, op8_mixing, op9_quality_rules
from . import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": q.op1_ngram_join,
    "op2_packing": q.op2_packing,
    "op3_line_dedup": q.op3_line_dedup,
    "op4_chat": q.op4_chat,
    "op5_html": q.op5_html,
    "op6_quality_classifier": q.op6_quality_classifier,
    "op7_embedding_dedup": q.op7_embedding_dedup,
    "op8_mixing": q.op8_mixing,
    "op10_sharding": q.op10_sharding,
    "op9_quality_rules": q.op9_quality_rules,
}

SQL: dict[str, str] = {"op3_line_dedup": op3_line_dedup.SQL, "op4_chat": op4_chat.SQL, "op8_mixing": op8_mixing.SQL, "op9_quality_rules": op9_quality_rules.SQL}
