"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import op4_byte_bpe
from tidemark.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tidemark.llm.line_dedup import OP6_SQL, op6_line_dedup
from tidemark.llm.media import op9_media
from tidemark.llm.near_dedup import op2_near_dedup
from tidemark.llm.packing import op5_packing
from tidemark.llm.quality import op8_quality
from tidemark.llm.sharding import op10_sharding
from tidemark.llm.suffix_dedup import op7_suffix_dedup
from tidemark.llm.token_counts import op3_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_near_dedup": op2_near_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_packing": op5_packing,
        "op6_line_dedup": op6_line_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_quality": op8_quality,
        "op9_media": op9_media,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op6_line_dedup": OP6_SQL,
    }
