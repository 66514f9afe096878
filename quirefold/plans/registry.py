"""All core queries and their SQL."""

from quirefold.plans import catalog, corpus, skew

MODULES = (corpus, catalog, skew)


def core_queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def core_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
