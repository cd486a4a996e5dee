"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from gristmill.llm import ballkmeans, bpe, brown, compression, decontamination, jaccard, lengths, licenses, packing, pii, rules, sharding, whitening

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_pii": pii.query,
    "op3_jaccard_join": jaccard.query,
    "op4_byte_bpe": bpe.query,
    "op5_token_lengths": lengths.query,
    "op6_quality_rules": rules.query,
    "op7_license_scan": licenses.query,
    "op8_class_language_model": brown.query,
    "op9_compression_classifier": compression.query,
    "op10_sharding": sharding.query,
    "op11_packing": packing.query,
    "op12_whitening": whitening.query,
    "op13_ball_kmeans": ballkmeans.query,
}
ORACLES = {"op6_quality_rules": rules.ORACLE}
