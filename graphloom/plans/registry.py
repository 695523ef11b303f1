"""Registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.sources.catalog import PRELUDE, Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True) -> Callable:
    """Register a function of a Catalog under its name, with SQL of the same result (after the shared views, if ``prelude``)."""

    def register(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Catalog(spark, folder))
        if sql is not None:
            own, begin = sql.strip(), "WITH"
            if own.upper().startswith("WITH RECURSIVE "):
                own, begin = f"WITH {own[15:]}", "WITH RECURSIVE"
            shared = PRELUDE.replace("WITH", begin, 1) + (f", {own[5:]}" if own[:5].upper() == "WITH " else own)
            ORACLES[f.__name__] = shared if prelude else sql
        return f

    return register
