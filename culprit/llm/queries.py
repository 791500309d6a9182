"""The registered queries of this folder and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from culprit.llm import bpe_transducer, entropy_mix, hilbert_clusters, html_tree, language_kernel, line_dedup, multi_index, piece_table, pivot_topk, quality_crf, simhash_trie, spotsigs, suffix_dedup

QUERIES = {
    "op1_spotsigs": spotsigs.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_quality_crf": quality_crf.op3,
    "op4_language_kernel": language_kernel.op4,
    "op5_html_tree": html_tree.op5,
    "op6_bpe_transducer": bpe_transducer.op6,
    "op7_pivot_topk": pivot_topk.op7,
    "op8_entropy_mix": entropy_mix.op8,
    "op9_suffix_dedup": suffix_dedup.op9,
    "op10_simhash_trie": simhash_trie.op10,
    "op11_piece_table": piece_table.op11,
    "op12_hilbert_clusters": hilbert_clusters.op12,
    "op13_multi_index": multi_index.op13,
}
ORACLES = {
    "op1_spotsigs": spotsigs.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op7_pivot_topk": pivot_topk.OP7_SQL,
    "op12_hilbert_clusters": hilbert_clusters.OP12_SQL,
    "op13_multi_index": multi_index.OP13_SQL,
}
