"""The registered queries of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from sedgeway.llm import bpe, lexical, license_scan, media, mixing, prefix_trie, quality, secret_scan, simhash, suffix_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_bpe": bpe.op3_bpe,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_media_columns": media.op10_media_columns,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_token_counts": token_counts.op13_token_counts,
}

ORACLES = {
    "op6_url_filter": url_filter.OP6_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
