"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hard_negatives, jaccard_join, line_dedup, page_text, quality, secrets, sentence_pieces, shards, simhash, token_alignment, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_kd_shards": shards.op2_kd_shards,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_page_text": page_text.op7_page_text,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_sentence_pieces": sentence_pieces.op10_sentence_pieces,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_simhash": simhash.op12_simhash,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
}
