"""The queries of this subpackage by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from framewright.plans.registry import Entry

LLM_QUERIES: dict[str, Entry] = {}


def llm_query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(function):
        LLM_QUERIES[function.__name__] = Entry(function, sql)
        return function

    return register
