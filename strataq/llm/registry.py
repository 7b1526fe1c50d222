"""Queries of the training-data operators with their SQL."""

from __future__ import annotations

from strataq.llm import collocations, exact_dedup, fingerprints, language_id, mixing, ngram_join, pieces, pii, quality_classifier, quality_rules, token_links, url_filters, warc

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_pii": pii.op3_pii,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_warc": warc.op5_warc,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_language_id": language_id.op7_language_id,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_collocations": collocations.op12_collocations,
    "op13_token_links": token_links.op13_token_links,
}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.OP2_SQL, "op4_ngram_join": ngram_join.OP4_SQL, "op5_warc": warc.OP5_SQL, "op6_url_filters": url_filters.OP6_SQL, "op10_quality_rules": quality_rules.OP10_SQL, "op12_collocations": collocations.OP12_SQL}
