"""Queries and oracle SQL of this folder and of the pipeline, for ``__spark_entry__``."""

from . import collocations, html_text, license_scan, mixing, near_dedup, packing, personal_data, quality_classifier, quality_rules, secret_scan, token_alignment, topk_search, warc

_MODULES = [near_dedup, packing, html_text, topk_search, quality_rules, quality_classifier, mixing, secret_scan, personal_data, warc, license_scan, token_alignment, collocations]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
