"""Queries of the training-data operators and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from planscope.llm import bm25_search, bpe, fingerprints, language_id, line_dedup, mixing, ngram_join, secrets_scan, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_secret_scan": secrets_scan.op4_secret_scan,
        "op5_bm25_search": bm25_search.op5_bm25_search,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_source_mix": mixing.op8_source_mix,
        "op9_language_id": language_id.op9_language_id,
        "op10_bpe": bpe.op10_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    out = {"op3_ngram_join": ngram_join.ORACLE, "op4_secret_scan": secrets_scan.ORACLE, "op5_bm25_search": bm25_search.ORACLE, "op6_url_filter": url_filter.ORACLE}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
