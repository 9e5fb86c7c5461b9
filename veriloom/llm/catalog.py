"""Registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from veriloom.llm import (
    bestfit, conversations, decontam, html, importance, lm, packing, quoting, simhash, toxicity, urls, vectors, whitening,
)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_packing": packing.query,
    "op3_language_model": lm.query,
    "op4_benchmark_decontamination": decontam.query,
    "op5_quotation_linking": quoting.query,
    "op6_html_extraction": html.query,
    "op7_quality_resampling": importance.query,
    "op8_simhash_near_duplicates": simhash.query,
    "op9_url_filter": urls.query,
    "op10_embedding_near_duplicates": vectors.query,
    "op11_conversation_repair": conversations.query,
    "op12_best_fit_packing": bestfit.query,
    "op13_embedding_whitening": whitening.query,
}
ORACLES: dict[str, str] = {}
