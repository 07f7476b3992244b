"""Every reference query by name, with the SQL its rows are compared with."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query (spark, data folder) under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


from larkspur.plans import queries_audit, queries_rules, queries_sql, queries_text  # noqa: E402, F401  they register themselves
