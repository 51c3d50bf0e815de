"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from docspark.llm import fingerprint, line_dedup, mixing, near_dedup, ngram_join, packing, quality_rules, ranked_search, rule_ensemble, secret_scan, substring_dedup, toxicity, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_packing": packing.op3_packing,
    "op4_secret_scans": secret_scan.op4_secret_scans,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_quality_classifier": rule_ensemble.op6_quality_classifier,
    "op7_mixing": mixing.op7_mixing,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_document_fingerprints": fingerprint.op9_document_fingerprints,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op10_minhash_near_dedup": near_dedup.OP10_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
    "op12_ngram_join": ngram_join.OP12_SQL,
}
