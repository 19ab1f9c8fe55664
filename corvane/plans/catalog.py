"""Registry of the library's queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import relational, textual

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**relational.QUERIES, **textual.QUERIES}
ORACLE_SQL: dict[str, str] = {**relational.ORACLE_SQL, **textual.ORACLE_SQL}
FLAGSHIP = "coverage_by_year"
