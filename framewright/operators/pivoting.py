"""Pivots with a fixed column set."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.names import column, quoted

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class _Refuse:
    """Marks that a value outside the list ends the query."""

    def __repr__(self) -> str:
        return "REFUSE"


REFUSE = _Refuse()


def _prefix(pivot: str, value: object) -> str:
    """Text stands for itself; other values and null follow the column's name."""
    return value if isinstance(value, str) else f"{pivot}_{'null' if value is None else value}"


def pivot_values(df: DataFrame, pivot: str, most: int = 100) -> list:
    """The values of a column in ascending order, null first, by one distinct.

    More than ``most`` of them are refused, not cut.
    """
    found = df.select(column(pivot).alias("value")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{pivot!r} has more than {most} values")
    return sorted((row["value"] for row in found), key=lambda v: (v is not None, v))


def pivot_measures(
    df: DataFrame,
    keys: Sequence[str],
    pivot: str,
    values: Sequence | Mapping,
    measures: Mapping[str, Column],
    other: str | _Refuse,
) -> DataFrame:
    """One row per key, one column per listed value and measure.

    ``values`` lists pivot values of any type, ``None`` for null, or maps each to
    a column prefix; ``pivot_values`` finds them. Columns are always
    ``<prefix>_<measure>``, also for a single measure, where Spark would drop the
    measure's name.

    The list is required: it fixes the schema. Nothing outside it is lost:
    ``other`` is the prefix of one more cell, which takes the rows of all other
    values, or ``REFUSE``, with which such a row ends the query. A listed value
    that never occurs gives null columns. An empty cell is null for every
    measure, counts included.
    """
    named = dict(values) if isinstance(values, Mapping) else {v: _prefix(pivot, v) for v in values}
    prefixes = [*named.values(), *([] if other is REFUSE else [other])]
    unsafe = [p for p in prefixes if not _IDENTIFIER.fullmatch(p)]
    if unsafe:
        raise ValueError(f"no column names: {unsafe}; map them to prefixes")
    if len({p.lower() for p in prefixes}) < len(prefixes):
        raise ValueError("two pivot values share one prefix")
    value = column(pivot)
    if other is REFUSE:
        text = F.coalesce(value.cast("string"), F.lit("null"))
        rest = F.raise_error(F.concat(F.lit(f"unlisted value in {pivot}: "), text)).cast("string")
    else:
        rest = F.lit(other)
    # one literal map, looked up once a row, however long the list
    kind = df.schema[pivot].dataType
    pairs = [
        part
        for listed, prefix in named.items()
        if listed is not None
        for part in (F.lit(listed).cast(kind), F.lit(prefix))
    ]
    cell = F.coalesce(F.element_at(F.create_map(*pairs), value), rest) if pairs else rest
    if None in named:
        cell = F.when(value.isNull(), F.lit(named[None])).otherwise(cell)
    label = "__cell"
    aggregates = [expr.alias(name) for name, expr in measures.items()]
    grouped = df.withColumn(label, cell).groupBy(*map(column, keys))
    wide = grouped.pivot(label, prefixes).agg(*aggregates)
    single = len(measures) == 1
    cells = [
        wide[quoted(prefix if single else f"{prefix}_{name}")].alias(f"{prefix}_{name}")
        for prefix in prefixes
        for name in measures
    ]
    return wide.select(*map(column, keys), *cells)
