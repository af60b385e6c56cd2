"""All registered queries of the library, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import document_queries, governance_queries, index_queries, prose_queries, reference_queries, structure_queries, upkeep_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**prose_queries.QUERIES, **reference_queries.QUERIES, **governance_queries.QUERIES, **document_queries.QUERIES, **index_queries.QUERIES, **structure_queries.QUERIES, **upkeep_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**prose_queries.ORACLE_SQL, **reference_queries.ORACLE_SQL, **governance_queries.ORACLE_SQL, **document_queries.ORACLE_SQL, **index_queries.ORACLE_SQL, **structure_queries.ORACLE_SQL, **upkeep_queries.ORACLE_SQL}
