"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from loamline.llm import bpe, centroids, fingerprints, html_text, importance_sample, kneser_ney, license_scan, minhash_dedup, packing, quality_classifier, quality_rules, token_files, toxicity

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_bpe": bpe.op4_bpe,
    "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_lm_scoring": kneser_ney.op7_lm_scoring,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_packing": packing.op9_packing,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_centroid_clusters": centroids.op11_centroid_clusters,
    "op12_html_text": html_text.op12_html_text,
    "op13_importance_sample": importance_sample.op13_importance_sample,
}

ORACLES = {
    "op2_license_scan": license_scan.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op5_minhash_dedup": minhash_dedup.ORACLE,
    "op11_centroid_clusters": centroids.ORACLE,
    "op13_importance_sample": importance_sample.ORACLE,
}
