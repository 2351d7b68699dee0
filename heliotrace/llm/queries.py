"""The queries of this package and their SQL."""

from __future__ import annotations

from heliotrace.llm import chat_format, decontamination, fingerprints, jaccard_join, lm_scoring, pii, sentencepiece_codec, token_counts, toxicity, url_filter

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_pii": pii.op5_pii,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_chat_formatting": chat_format.op9_chat_formatting,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}
ORACLES: dict[str, str] = {
    "op3_url_filters": url_filter.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op9_chat_formatting": chat_format.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
}
