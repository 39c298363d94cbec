"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from strata.llm import bpe, chats, clusters, licenses, mixing, near, periods, quality, secrets, suffixes, token_counts, topk, urls

QUERIES = {
    "op1_jaccard_join": near.op1_jaccard_join,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_pivot_topk": topk.op3_pivot_topk,
    "op4_bpe_roundtrip": bpe.op4_bpe_roundtrip,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_quality_rules": quality.op6_quality_rules,
    "quality_ablation": quality.quality_ablation,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_chat_format": chats.op10_chat_format,
    "chat_tool_links": chats.chat_tool_links,
    "op11_centroid_clusters": clusters.op11_centroid_clusters,
    "op12_url_filter": urls.op12_url_filter,
    "op13_periodic_runs": periods.op13_periodic_runs,
}

ORACLE_SQL = {
    "op3_pivot_topk": topk.OP3_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "quality_ablation": quality.ABLATION_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op8_source_mix": mixing.OP8_SQL,
    "op10_chat_format": chats.OP10_SQL,
    "chat_tool_links": chats.LINKS_SQL,
    "op11_centroid_clusters": clusters.OP11_SQL,
    "op12_url_filter": urls.OP12_SQL,
}
