"""The operators' queries over the given tables, and their SQL."""

from __future__ import annotations

from . import backoff, chat, decontaminate, gam, infill, licenses, naming, near, packing, prefixes, shards, simhash, toxicity

QUERIES = {
    "op1_karmarkar_karp": shards.op1_karmarkar_karp,
    "op2_string_kernel": toxicity.op2_string_kernel,
    "op3_stupid_backoff": backoff.op3_stupid_backoff,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_multi_index_hamming": near.op5_multi_index_hamming,
    "op6_incremental_rendering": chat.op6_incremental_rendering,
    "op7_positional_index": decontaminate.op7_positional_index,
    "op8_best_fit": packing.op8_best_fit,
    "op9_additive_quality": gam.op9_additive_quality,
    "op10_block_naming": naming.op10_block_naming,
    "op11_radix_tree": prefixes.op11_radix_tree,
    "op12_trie_join": simhash.op12_trie_join,
    "op13_seekable_frames": infill.op13_seekable_frames,
}
SQL = {
    "op3_stupid_backoff": backoff.OP3_SQL,
    "op4_license_scan": licenses.OP4_SQL,
    "op5_multi_index_hamming": near.OP5_SQL,
    "op6_incremental_rendering": chat.OP6_SQL,
    "op7_positional_index": decontaminate.OP7_SQL,
    "op10_block_naming": naming.OP10_SQL,
    "op11_radix_tree": prefixes.OP11_SQL,
    "op13_seekable_frames": infill.OP13_SQL,
}
