"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from turnloom.llm import (
    chat, exact_dedup, jaccard, language, licenses, line_chunks, merkle, mixing, packing, pii, quality, repair,
    secret_scan,
)

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_language_id": language.op5_language_id,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_temperature_mixing": mixing.op7_temperature_mixing,
    "op8_personal_data": pii.op8_personal_data,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_line_chunks": line_chunks.op10_line_chunks,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_conversation_repair": repair.op12_conversation_repair,
    "op13_license_scan": licenses.op13_license_scan,
}
ORACLE = {
    "op1_ngram_jaccard": jaccard.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_temperature_mixing": mixing.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_conversation_repair": repair.ORACLE,
    "op13_license_scan": licenses.ORACLE,
}
