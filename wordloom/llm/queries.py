"""The queries of this subpackage and their SQL: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_tokens, op2_near_dedup, op3_binary, op4_score, op5_decontaminate, op6_lines, op7_licenses, op8_bpe, op9_html, op10_quality
from .common import read, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": lambda s, d: op1_tokens.count_tokens(read(s, d, "documents"), vocabulary("byte_bpe_50k.json")),
        "op2_near_dedup": lambda s, d: op2_near_dedup.classes(read(s, d, "documents")),
        "op3_token_files": lambda s, d: op3_binary.token_file_round_trip(read(s, d, "documents"), vocabulary("byte_bpe_50k.json"), shared_dir(s)),
        "op4_gru_score": lambda s, d: op4_score.score_documents(read(s, d, "documents")),
        "op5_decontamination": lambda s, d: op5_decontaminate.report(read(s, d, "documents"), read(s, d, "benchmark")),
        "op6_line_dedup": lambda s, d: op6_lines.line_report(read(s, d, "documents")),
        "op7_license_scan": lambda s, d: op7_licenses.scan_licenses(read(s, d, "documents")),
        "op8_bpe_round_trip": lambda s, d: op8_bpe.encode_decode(read(s, d, "documents"), vocabulary("word_bpe_49k.json")),
        "op9_main_text": lambda s, d: op9_html.extract_pages(read(s, d, "pages")),
        "op10_quality_rules": lambda s, d: op10_quality.quality_report(read(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": op6_lines.ORACLE, "op10_quality_rules": op10_quality.ORACLE}
