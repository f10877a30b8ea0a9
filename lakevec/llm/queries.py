"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lakevec.llm import decontaminate, html_text, language_id, license_scan, line_dedup, mixing, ngram_join, periodic_runs, resampling, substring_dedup, toxicity, url_filter, vector_scan

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_license_scan": license_scan.op3,
    "op4_ngram_jaccard_join": ngram_join.op4,
    "op5_toxicity": toxicity.op5,
    "op6_html_extraction": html_text.op6,
    "op7_vector_scan": vector_scan.op7,
    "op8_mixing": mixing.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_language_id": language_id.op10,
    "op11_url_filter": url_filter.op11,
    "op12_periodic_runs": periodic_runs.op12,
    "op13_importance_resampling": resampling.op13,
}

ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_decontamination": decontaminate.OP2_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op11_url_filter": url_filter.OP11_SQL,
}
