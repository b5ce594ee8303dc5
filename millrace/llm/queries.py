"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, exact_dedup, html_text, license_scan, lm_score, ngram_join, sentencepiece_fst, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_url_filter": url_filter.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_html_text": html_text.query,
    "op5_license_scan": license_scan.query,
    "op6_lm_score": lm_score.query,
    "op7_sentencepiece": sentencepiece_fst.query,
    "op8_toxicity": toxicity.query,
    "op9_ngram_join": ngram_join.query,
    "op10_decontaminate": decontaminate.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_url_filter": url_filter.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
}
