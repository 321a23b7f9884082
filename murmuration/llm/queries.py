"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import content_sort, importance_resampling, jaccard_join, language_ppm, lexical_search, matroska, mixing, packing, quality_rank, quality_rules, secret_scan, toxicity, url_filter

QUERIES = {
    "op1_matroska": matroska.op1_matroska,
    "op2_mixing": mixing.op2_mixing,
    "op3_packing": packing.op3_packing,
    "op4_language_ppm": language_ppm.op4_language_ppm,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_content_sort": content_sort.op8_content_sort,
    "op9_quality_rank": quality_rank.op9_quality_rank,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}
ORACLE_SQL = {
    "op2_mixing": mixing.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op6_url_filter": url_filter.SQL,
    "op8_content_sort": content_sort.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op13_importance_resampling": importance_resampling.SQL,
}
