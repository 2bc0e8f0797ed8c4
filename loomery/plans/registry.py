"""The library's queries and, where SQL can express them, the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomery.plans import documents, graph, relational, streams, vectors

PLANS = (documents, vectors, graph, relational, streams)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q for p in PLANS for n, q in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: q for p in PLANS for n, q in p.ORACLE_SQL.items()}

flagship = documents.bm25_top
