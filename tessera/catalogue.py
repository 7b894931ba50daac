"""Registered queries of the engine's own operators, with the SQL each is compared to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import attached, buffers, curation, evaluation, gates, knowledge, records, retrieval, sessions

MODULES = (records, retrieval, sessions, knowledge, curation, evaluation, gates, buffers, attached)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in MODULES for name, sql in module.SQL.items()}
