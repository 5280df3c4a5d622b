"""Where plan modules put their queries and the SQL that repeats them."""

from __future__ import annotations

from ..sources.fixtures import SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    """Register a query; sql goes on from the shared table expressions (base), or stands alone."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = SQL + sql if base else sql
        return f

    return keep
