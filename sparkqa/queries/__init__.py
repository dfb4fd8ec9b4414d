"""The registered queries, with their SQL, by field of work."""

from __future__ import annotations


def modules():
    from sparkqa.queries import conversations, logs, plans, tables, texts

    return [plans, tables, texts, logs, conversations]


def queries() -> dict:
    return {name: query for m in modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in modules() for name, sql in m.SQL.items()}
