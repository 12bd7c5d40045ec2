"""All registered queries of the reference's operators, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import catalogue_queries, corpus_queries, retrieval_queries, service_queries, stored_queries, text_queries

FLAGSHIP = "hybrid_search"
Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = (text_queries, retrieval_queries, corpus_queries, service_queries, catalogue_queries, stored_queries)


def queries() -> dict[str, Query]:
    return {name: q for family in FAMILIES for name, (q, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
