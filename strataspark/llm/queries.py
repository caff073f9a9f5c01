"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, hard_negatives, language_mixture, language_model, packing, pii, pivot_clustering, quality_classifier, quality_rules, sentencepiece_codec, simhash, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_embedding_near_dedup": embedding_dedup.op2_embedding_near_dedup,
    "op3_language_model": language_model.op3_language_model,
    "op4_pii": pii.op4_pii,
    "op5_simhash": simhash.op5_simhash,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_warc": warc.op9_warc,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_language_mixture": language_mixture.op11_language_mixture,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_pivot_clustering": pivot_clustering.op13_pivot_clustering,
}

ORACLE_SQL: dict[str, str] = {"op9_warc": warc.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_pivot_clustering": pivot_clustering.ORACLE}
