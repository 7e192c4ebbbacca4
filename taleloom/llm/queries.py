"""The registered queries of this package and their SQL."""

from __future__ import annotations

from taleloom.plans.registry import Query

from . import chat, exact_dedup, jaccard_join, near_dedup, packing, periodic_runs, prefix_trie, private_data, quality, sharding, suffix_dedup, token_counts, word_table

QUERIES = {
    "op1_feistel_shards": Query(sharding.op1_feistel_shards),
    "op2_prefix_token_counts": Query(token_counts.op2_prefix_token_counts),
    "op3_pack_best_fit": Query(packing.op3_pack_best_fit),
    "op4_exact_dedup": Query(exact_dedup.op4_exact_dedup, exact_dedup.OP4_SQL),
    "op7_adaptive_quality": Query(quality.op7_adaptive_quality, quality.OP7_SQL),
    "op8_word_table_bpe": Query(word_table.op8_word_table_bpe),
    "op6_suffix_dedup": Query(suffix_dedup.op6_suffix_dedup),
    "op9_bag_min_hash": Query(near_dedup.op9_bag_min_hash),
    "op10_disclosure": Query(private_data.op10_disclosure),
    "op5_prefix_targets": Query(chat.op5_prefix_targets),
    "op11_jaccard_join": Query(jaccard_join.op11_jaccard_join),
    "op12_prefix_trie": Query(prefix_trie.op12_prefix_trie, prefix_trie.OP12_SQL),
    "op13_periodic_runs": Query(periodic_runs.op13_periodic_runs),
}
