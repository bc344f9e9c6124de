"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, html_extract, line_dedup, ngram_join, piece_sampling, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_piece_sampling": piece_sampling.op2_piece_sampling,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
}
