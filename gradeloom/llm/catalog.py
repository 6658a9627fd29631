"""Registered queries of the operators for training text: name -> (function, SQL or None)."""

from __future__ import annotations

from . import chat_format, collocations, decontaminate, license_scan, near_dup, ngram_lm, packing, prefix_trie, quality_rules, substring_dedup, suffix_dedup, token_files, toxicity

QUERIES: dict = {
    "op1_packing": (packing.query, None),
    "op2_suffix_dedup": (suffix_dedup.query, suffix_dedup.SQL),
    "op3_toxicity": (toxicity.query, None),
    "op4_quality_rules": (quality_rules.query, None),
    "op5_near_dup": (near_dup.query, near_dup.SQL),
    "op6_license_scan": (license_scan.query, None),
    "op7_decontaminate": (decontaminate.query, decontaminate.SQL),
    "op8_ngram_lm": (ngram_lm.query, None),
    "op9_substring_dedup": (substring_dedup.query, substring_dedup.SQL),
    "op10_chat_format": (chat_format.query, chat_format.SQL),
    "op11_prefix_trie": (prefix_trie.query, prefix_trie.SQL),
    "op12_collocations": (collocations.query, collocations.SQL),
    "op13_token_files": (token_files.query, None),
}
