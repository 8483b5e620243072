"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from corvid.llm import decontaminate, exact_dedup, hnsw, language_id, lm_score, mixing, ngram_join, pii, quality, runs, sharding, url_filter, vector_code

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_lm_scoring": lm_score.op2_lm_scoring,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_pii": pii.op5_pii,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_sharding": sharding.op7_sharding,
    "op8_mixing": mixing.op8_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_nearest_neighbours": hnsw.op12_nearest_neighbours,
    "op13_vector_codes": vector_code.op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}

SQL = {**exact_dedup.SQL, **vector_code.SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
