"""Queries over the given tables, one for each operator, each with its SQL where SQL can say it."""

from importlib import import_module

MODULES = ("scans", "joins", "aggregates", "functions", "writes", "search", "sources")


def all_queries() -> tuple[dict, dict]:
    """All queries by name, and the SQL of those that have one."""
    for name in MODULES:
        import_module(f"engram.plans.{name}")
    from engram.plans.views import ORACLE_SQL, QUERIES

    return QUERIES, ORACLE_SQL
