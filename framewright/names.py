"""Column names: how they are quoted, and when two of them are one to Spark."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A name as a reference that no dot or backtick in it can change."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The column of exactly this name."""
    return F.col(quoted(name))


def shared_names(df: DataFrame, some: Iterable[str], others: Iterable[str]) -> list[str]:
    """The names among ``others`` that Spark can't tell from one of ``some``."""
    fold = _fold(df)
    known = {fold(name) for name in some}
    return sorted(name for name in others if fold(name) in known)


def repeated_names(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The names that occur again in the same list."""
    fold, seen, again = _fold(df), set(), []
    for name in names:
        if fold(name) in seen:
            again.append(name)
        seen.add(fold(name))
    return again


def _fold(df: DataFrame):
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    return str if exact else str.lower
