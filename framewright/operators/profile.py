"""Grouped and global statistics in a single aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from framewright.functions.measures import exact_avg, wide_sum
from framewright.names import column, quoted, repeated_names
from framewright.operators.averages import stable_average

_FUNCTIONS = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def profile(
    df: DataFrame,
    keys: Sequence[str] = (),
    measures: Mapping[str, str | Sequence[str]] | None = None,
    rows: str | None = "n_rows",
    extra: Mapping[str, Column] | None = None,
    scales: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per key combination, or one row in all when ``keys`` is empty.

    ``measures`` maps a column to one or more of ``avg``, ``min``, ``max``,
    ``sum``, ``wide_sum``, ``exact_avg`` and ``stable_avg``; each result is named
    ``<function>_<column>``. ``wide_sum`` takes integer columns only;
    ``exact_avg`` also takes fractions, whose decimal places ``scales`` gives.
    ``stable_avg`` takes any numbers and rounds once (``stable_average``); each one
    is an aggregate of its own, joined on the keys, and reads ``df`` again.
    ``rows`` names the row count (nulls count too), ``None`` leaves it out.
    ``extra`` takes any other aggregate under its own name.

    All measures share one partial and one final aggregate, so a group holding
    most of the rows is reduced to one row per task before the shuffle.
    """
    aggregates = [] if rows is None else [F.count("*").alias(rows)]
    names_in_order = [*keys, *([] if rows is None else [rows])]
    stable = []
    for source, names in (measures or {}).items():
        for name in [names] if isinstance(names, str) else names:
            names_in_order.append(f"{name}_{source}")
            if name == "stable_avg":
                stable.append(source)
                continue
            measure = _measure(df, source, name, scales or {})
            aggregates.append(measure.alias(f"{name}_{source}"))
    aggregates += [expr.alias(name) for name, expr in (extra or {}).items()]
    names_in_order += list(extra or {})
    if not aggregates and not stable:
        raise ValueError("nothing to compute")
    if repeated_names(df, names_in_order):
        raise ValueError(f"output names repeat: {names_in_order}")
    # without another measure, a count that the last select leaves out
    result = df.groupBy(*map(column, keys)).agg(*(aggregates or [F.count("*").alias("__rows")]))
    for source in stable:
        average = stable_average(df, keys, source, f"stable_avg_{source}")
        result = _joined_on_keys(result, average, keys)
    return result.select(*map(column, names_in_order)) if stable else result


def _joined_on_keys(result: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both aggregates side by side; null keys meet, and so do global rows."""
    renamed = other.withColumnsRenamed({key: f"__key_{i}" for i, key in enumerate(keys)})
    same = F.lit(True)
    for i, key in enumerate(keys):
        same &= column(key).eqNullSafe(F.col(f"__key_{i}"))
    return result.join(renamed, same).drop(*(f"__key_{i}" for i in range(len(keys))))


def _measure(df: DataFrame, source: str, name: str, scales: Mapping[str, int]) -> Column:
    if name in _FUNCTIONS:
        return _FUNCTIONS[name](column(source))
    if name not in ("wide_sum", "exact_avg"):
        known = sorted([*_FUNCTIONS, "wide_sum", "exact_avg", "stable_avg"])
        raise ValueError(f"unknown measure {name!r}, use {known}")
    whole = isinstance(df.schema[source].dataType, IntegralType)
    if name == "wide_sum":
        if not whole:
            raise ValueError(f"wide_sum needs an integer column, {source!r} is none")
        return wide_sum(quoted(source))
    if whole:
        return wide_sum(quoted(source)).cast("double") / F.count(column(source))
    if source not in scales:
        raise ValueError(f"exact_avg needs the decimal places of {source!r} in scales")
    return exact_avg(quoted(source), scales[source])
