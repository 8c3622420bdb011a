"""All queries of the library by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from quorumlake.plans import content_queries, crawl_queries, document_queries, history_queries, interface_queries, retrieval_queries, rule_queries, run_queries, scoring_queries, statute_queries, store_queries, text_queries, upkeep_queries
from quorumlake.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _part in (scoring_queries, text_queries, history_queries, rule_queries, upkeep_queries, store_queries, statute_queries, content_queries, retrieval_queries, crawl_queries, interface_queries, run_queries, document_queries):
    QUERIES |= _part.R.queries
    ORACLES |= _part.R.oracles
