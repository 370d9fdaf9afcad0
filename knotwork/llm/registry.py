"""The queries of the numbered operators, and SQL where it can express them."""

from __future__ import annotations

from . import byte_bpe, conversation_trie, decontamination, license_scan, line_dedup, media_mpeg, ngram_join, pii, source_divergence, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_suffix_array_dedup": suffix_dedup.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_license_scan": license_scan.query,
    "op5_pii": pii.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_media_mpeg": media_mpeg.query,
    "op8_toxicity": toxicity.query,
    "op9_ngram_jaccard_join": ngram_join.query,
    "op10_decontamination": decontamination.query,
    "op11_source_divergence": source_divergence.query,
    "op12_conversation_trie": conversation_trie.query,
    "op13_warc": warc.query,
}

ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op11_source_divergence": source_divergence.SQL,
    "op12_conversation_trie": conversation_trie.SQL,
    "op13_warc": warc.SQL,
}
