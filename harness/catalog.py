"""All registered queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from careerlake.session import tune
from harness import chatting, cleaning, dashboard, loading, merging, searching

MODULES = [dashboard, cleaning, merging, searching, chatting, loading]

Query = Callable[[SparkSession, str], DataFrame]


def tuned(query: Query) -> Query:
    return lambda spark, sf: query(tune(spark), sf.rstrip("/"))


def queries() -> dict[str, Query]:
    return {name: tuned(q) for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
