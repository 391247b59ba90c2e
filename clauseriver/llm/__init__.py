"""Operators of a training-data pipeline. Nothing else in the package imports this one."""

from clauseriver.llm import (
    chat_format,
    html_extract,
    lm_score,
    merkle_log,
    near_dedup,
    packing,
    pii,
    quality_rules,
    source_audit,
    source_mix,
    substring_dedup,
    url_filter,
    vp_search,
)

QUERIES = {
    "op1_vp_search": vp_search.op1_vp_search,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_source_mix": source_mix.op3_source_mix,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_pii": pii.op6_pii,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_packing": packing.op9_packing,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_merkle_manifest": merkle_log.op11_merkle_manifest,
    "op12_lm_score": lm_score.op12_lm_score,
    "op13_source_audit": source_audit.op13_source_audit,
}
#: The others are beyond SQL; tests/llm holds them against brute force.
ORACLES = {
    "op3_source_mix": source_mix.OP3_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_merkle_manifest": merkle_log.OP11_SQL,
    "op13_source_audit": source_audit.OP13_SQL,
}
