"""Queries and SQL of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, language_id, merkle, near_dup, packing, prefix_trie, quality, secrets, token_counts, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_bpe,
        near_dup.op2_near_dedup,
        toxicity.op3_toxicity,
        token_counts.op4_token_counts,
        embedding_dedup.op5_embedding_dedup,
        url_filter.op6_url_filter,
        quality.op7_quality,
        exact_dedup.op8_exact_dedup,
        packing.op9_packing,
        secrets.op10_secret_scan,
        prefix_trie.op11_prefix_trie,
        language_id.op12_language_id,
        merkle.op13_merkle_manifest,
    )
}
ORACLE_SQL = {
    "op5_embedding_dedup": embedding_dedup.OP5_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
