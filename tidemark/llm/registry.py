"""Queries of the operators by name, and the DuckDB SQL of those that SQL can express."""

from . import bpe, decontaminate, html_text, jaccard_join, language_model, licenses, line_dedup, quality, toxicity, url_filter

QUERIES = {
    "op1_html_extraction": html_text.op1_html_extraction,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_lm_scoring": language_model.op3_lm_scoring,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_ngram_jaccard": jaccard_join.op8_ngram_jaccard,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe": bpe.op10_bpe,
}
ORACLE_SQL = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_license_scan": licenses.ORACLE,
    "op8_ngram_jaccard": jaccard_join.ORACLE,
}
