"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express on whole tables."""

from . import align, host_rules, line_dedup, merkle, mixing, mpegts, packing, repeats, simhash_dedup, suffix_tree_lm, toxicity, url_filter, weak_quality

QUERIES = {
    "op1_mpegts": mpegts.op1_mpegts,
    "op2_packing": packing.op2_packing,
    "op3_suffix_tree": suffix_tree_lm.op3_suffix_tree,
    "op4_host_rules": host_rules.op4_host_rules,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_simhash": simhash_dedup.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_weak_quality": weak_quality.op8_weak_quality,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_url_markov": url_filter.op10_url_markov,
    "op11_merkle": merkle.op11_merkle,
    "op12_align": align.op12_align,
    "op13_repeats": repeats.op13_repeats,
}
SQL = {"op4_host_rules": host_rules.SQL, "op5_line_dedup": line_dedup.SQL, "op10_url_markov": url_filter.SQL, "op11_merkle": merkle.SQL}
