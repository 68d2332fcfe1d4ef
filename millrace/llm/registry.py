"""The registered queries of this package and their SQL."""

from millrace.llm import collocations, decontaminate, hard_negatives, html_text, language_id, mixing, near_dup, pii, quality, sharding, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_pii": pii.op5_pii,
    "op3_language_id": language_id.op3_language_id,
    "op6_toxicity": toxicity.op6_toxicity,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op7_near_dup": near_dup.op7_near_dup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_quality": quality.op9_quality,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_shard_tree": sharding.op12_shard_tree,
    "op13_collocations": collocations.op13_collocations,
}
SQL = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op7_near_dup": near_dup.OP7_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op9_quality": quality.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_shard_tree": sharding.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
