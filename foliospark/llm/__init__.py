"""Operators for preparing training text at scale. Nothing else in the library imports this package."""

from foliospark.llm import collocations, decontaminate, hmm_scores, html_extract, mixing, periodic_runs, quality, sharding, simhash_gph, suffix_dedup, topk_search, toxicity, url_filter

MODULES = (html_extract, decontaminate, url_filter, suffix_dedup, mixing, hmm_scores, simhash_gph, quality, toxicity, topk_search, sharding, collocations, periodic_runs)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
