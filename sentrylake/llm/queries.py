"""Queries of the training-data operators and their oracle SQL."""

from sentrylake.llm import decontaminate, jaccard_join, line_rules, mixing, plane_clusters, quality_model, secret_scan, source_audit, suffix_dedup, token_counts, token_output, toxicity, warc

QUERIES = {
    "op1_token_counts": token_counts.op1,
    "op2_warc": warc.op2,
    "op3_mixing": mixing.op3,
    "op4_toxicity": toxicity.op4,
    "op5_token_output": token_output.op5,
    "op6_quality_model": quality_model.op6,
    "op7_secret_scan": secret_scan.op7,
    "op8_line_rules": line_rules.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_jaccard_join": jaccard_join.op10,
    "op11_source_audit": source_audit.op11,
    "op12_plane_clusters": plane_clusters.op12,
    "op13_suffix_dedup": suffix_dedup.op13,
}
ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_jaccard_join": jaccard_join.OP10_SQL,
    "op11_source_audit": source_audit.OP11_SQL,
    "op12_plane_clusters": plane_clusters.OP12_SQL,
    "op13_suffix_dedup": suffix_dedup.OP13_SQL,
}
