"""Queries over the bundled tables with their SQL twins, keyed by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skerry.plans import arms, assemblies, census, models, pairs, records, screens, spatial, vocab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (pairs, census, spatial, records, models, screens, assemblies, vocab, arms):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
