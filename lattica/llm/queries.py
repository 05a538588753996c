"""The ten operators as queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline

from lattica.llm import decontam, html_extract, lm_score, packing, pii, quality, sharding, simhash, toxicity, url_filter

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_toxicity": toxicity.query,
    "op3_quality_rules": quality.query,
    "op4_url_filter": url_filter.query,
    "op5_feistel_shards": sharding.query,
    "op6_pii_surrogates": pii.query,
    "op7_simhash": simhash.query,
    "op8_decontaminate": decontam.query,
    "op9_pack": packing.query,
    "op10_lm_score": lm_score.query,
    "pipeline": corpus_pipeline.run,
    # Those parts of op3 and op4 that SQL can express.
    "quality_base_counts": quality.base_query,
    "url_rules": url_filter.rules_query,
}
ORACLE_SQL = {"quality_base_counts": quality.BASE_SQL, "url_rules": url_filter.RULES_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
