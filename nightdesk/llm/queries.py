"""All queries of this package."""

from nightdesk.llm import decontaminate, exact_dedup, jaccard_join, language, lm_score, packing, periodic_runs, preference, ranked_search, simhash, toxicity, url_rules, warc  # noqa: F401
from nightdesk.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
