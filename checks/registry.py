"""Registry of checked queries: a Spark callable and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import oracle_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def checked(name: str, uses: str = "", sql: str | None = None):
    """Register a query. `uses` names derived tables; `sql` may start with its own WITH list."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            derived, text = oracle_with(uses.split()), sql.strip()
            if derived and text.upper().startswith("WITH "):
                ORACLE[name] = f"WITH {derived},\n{text[5:]}"
            elif derived:
                ORACLE[name] = f"WITH {derived}\n{text}"
            else:
                ORACLE[name] = text
        return fn

    return register
