"""Registered queries of the corpus operators, and SQL where it can say the same."""

import corpus_pipeline

from . import bpe, exact_dedup, html_extract, jaccard_join, katz, langid, mixing, simhash, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_language_id": langid.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_lm_scoring": katz.op7_lm_scoring,
    "op8_mixing": mixing.op8_mixing,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_fingerprints": simhash.op10_fingerprints,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op4_exact_dedup": exact_dedup.SQL, "op6_jaccard_join": jaccard_join.SQL, "op9_url_filter": url_filter.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
