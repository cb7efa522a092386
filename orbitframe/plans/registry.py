"""Where queries and their SQL are registered side by side."""

from __future__ import annotations

from .adapters import with_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(tables, sql)
        return run

    return keep
