"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlode.plans import quantities, retrieval, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**quantities.QUERIES, **retrieval.QUERIES}
SQL: dict[str, str] = sql.SQL
