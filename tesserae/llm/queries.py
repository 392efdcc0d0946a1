"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tesserae.llm import op01_chat, op02_decontaminate, op03_fingerprint, op04_chunks, op05_language, op06_lm, op07_mixing, op08_pii, op09_toxicity, op10_simhash, op11_infilling, op12_filter_audit, op13_extraction

QUERIES = {
    "op1_chat_formatting": op01_chat.op1_chat_formatting,
    "op2_benchmark_decontamination": op02_decontaminate.op2_benchmark_decontamination,
    "op3_document_fingerprints": op03_fingerprint.op3_document_fingerprints,
    "op4_substring_dedup": op04_chunks.op4_substring_dedup,
    "op5_language_id": op05_language.op5_language_id,
    "op6_lm_scoring": op06_lm.op6_lm_scoring,
    "op7_source_mixing": op07_mixing.op7_source_mixing,
    "op8_pii_surrogates": op08_pii.op8_pii_surrogates,
    "op9_toxicity": op09_toxicity.op9_toxicity,
    "op10_simhash_near_dedup": op10_simhash.op10_simhash_near_dedup,
    "op11_fill_in_middle": op11_infilling.op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit.op12_filter_audit,
    "op13_html_extraction": op13_extraction.op13_html_extraction,
}

ORACLE_SQL = {
    "op1_chat_formatting": op01_chat.SQL,
    "op2_benchmark_decontamination": op02_decontaminate.SQL,
    "op11_fill_in_middle": op11_infilling.SQL,
    "op12_filter_audit": op12_filter_audit.SQL,
    "op13_html_extraction": op13_extraction.SQL,
}
