"""Filter, project and derive in one step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from framewright.names import column, repeated_names, shared_names


def filter_derive(
    df: DataFrame,
    condition: Column | None = None,
    keep: Sequence[str] | None = None,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows where ``condition`` is true, with kept and derived columns.

    A null condition drops the row. ``keep`` lists the input columns to carry,
    in output order, or ``None`` for all of them; ``derived`` columns follow
    under their own names. A derived name that would shadow a kept column, or
    that Spark can't tell from another, is refused, since plain ``withColumn``
    replaces it without a word.
    """
    derived = derived or {}
    kept = list(df.columns if keep is None else keep)
    clashes = shared_names(df, kept, derived) + repeated_names(df, derived)
    if clashes:
        raise ValueError(f"derived columns shadow kept columns: {clashes}")
    if condition is not None:
        df = df.filter(condition)
    return df.select(*map(column, kept), *(expr.alias(name) for name, expr in derived.items()))
