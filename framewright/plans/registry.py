"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str


QUERIES: dict[str, Entry] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a function under its own name, next to its SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = Entry(function, sql)
        return function

    return register
