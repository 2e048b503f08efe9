"""The registered queries and, where there is one, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliograph.plans import packages, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = tables.QUERIES | packages.QUERIES
ORACLE_SQL: dict[str, str] = tables.SQL | packages.SQL
