"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sparkqa.llm import chat_format, exact_dedup, fingerprint, line_dedup, mixing, packing, periodic_runs, prefix_trie, shards, simhash, suffix_dedup, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_simhash": simhash.op3_simhash,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_packing": packing.op5_packing,
        "op6_fingerprint": fingerprint.op6_fingerprint,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_shards": shards.op8_shards,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_line_dedup": line_dedup.op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.SQL,
        "op4_url_filter": url_filter.SQL,
        "op7_chat_format": chat_format.SQL,
        "op10_exact_dedup": exact_dedup.SQL,
        "op12_prefix_trie": prefix_trie.SQL,
        "op13_line_dedup": line_dedup.SQL,
    }
