"""Every registered query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, lexical, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = lexical.QUERIES | corpus.QUERIES | readers.QUERIES
ORACLE_SQL: dict[str, str] = lexical.ORACLE_SQL | corpus.ORACLE_SQL | readers.ORACLE_SQL | {"bm25_saved_topk": lexical.ORACLE_SQL["bm25_topk"]}
