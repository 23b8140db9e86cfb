"""The queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from docspark.llm import chat_format, jaccard_join, language_id, line_dedup, merkle, mixing, packing, pitman_yor, quality, sketch, suffix_dedup, tokens, vector_codes

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_document_sketch": sketch.op3_document_sketch,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_pitman_yor": pitman_yor.op11_pitman_yor,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op3_document_sketch": sketch.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op7_ngram_jaccard": jaccard_join.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
