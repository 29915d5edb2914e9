"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import conversation_repair, cutting, exact_dedup, fingerprint, mixing, near_dedup, packing, pii, sentence_spans, spelling, substrings, toxicity, url_filter

QUERIES = {
    "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_sentence_span_dedup": sentence_spans.op3_sentence_span_dedup,
    "op4_multiset_fingerprints": fingerprint.op4_multiset_fingerprints,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_poisson_mixing": mixing.op8_poisson_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_personal_data": pii.op10_personal_data,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_cutting_stock_packing": cutting.op12_cutting_stock_packing,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLES = {
    "op3_sentence_span_dedup": sentence_spans.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op8_poisson_mixing": mixing.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
