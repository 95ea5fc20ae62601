"""Queries of this subpackage and their SQL."""

from loomspan.llm import centroids, class_lm, decontaminate, divergence, gif, html_extract, jaccard_join, packing, quality, sharding, token_counts, token_files, url_filter

MODULES = (decontaminate, html_extract, class_lm, sharding, url_filter, token_counts, quality, jaccard_join, packing, gif, centroids, token_files, divergence)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
