"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from weighbridge.llm import op1_bpe, op10_language, op11_chunks, op12_search, op13_codes, op2_mix, op3_neardup, op4_repeats, op5_secrets, op6_neighbours, op7_quality, op8_html, op9_personal

QUERIES = {
    "op1_byte_bpe": op1_bpe.query,
    "op2_source_mix": op2_mix.query,
    "op3_minhash_neardup": op3_neardup.query,
    "op4_suffix_repeats": op4_repeats.query,
    "op5_secret_scan": op5_secrets.query,
    "op6_forest_neighbours": op6_neighbours.query,
    "op7_quality_rules": op7_quality.query,
    "op8_html_article": op8_html.query,
    "op9_personal_data": op9_personal.query,
    "op10_language_id": op10_language.query,
    "op11_chunk_reuse": op11_chunks.query,
    "op12_ranked_search": op12_search.query,
    "op13_vector_codes": op13_codes.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": op2_mix.SQL,
    "op3_minhash_neardup": op3_neardup.SQL,
    "op5_secret_scan": op5_secrets.SQL,
    "op7_quality_rules": op7_quality.SQL,
    "op12_ranked_search": op12_search.SQL,
    "op13_vector_codes": op13_codes.SQL,
}
