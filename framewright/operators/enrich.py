"""Inner joins on a shared key."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from framewright.names import shared_names
from framewright.sources.tables import lookup_table


def join_on_key(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner equi-join with one copy of each key and no ambiguous column.

    The key comes first, then the other left columns, then the other right
    ones. A further name on both sides, or key types that differ, is refused:
    the first would only fail at a later reference, the second would cast one
    side and keep its pushed filters from the scan.

    No join hint is set. Spark broadcasts a side whose size it knows to be
    under the broadcast threshold and shuffles both otherwise; adaptive
    execution then splits a key that holds an outsized share of the rows.
    """
    keys = [on] if isinstance(on, str) else list(on)
    rest = [name for name in right.columns if name not in keys]
    shared = shared_names(left, left.columns, rest)
    if shared:
        raise ValueError(f"columns on both sides besides the key: {shared}")
    for key in keys:
        if key not in left.columns or key not in right.columns:
            raise ValueError(f"key {key!r} is missing on one side")
        types = left.schema[key].dataType, right.schema[key].dataType
        if types[0] != types[1]:
            raise ValueError(
                f"key {key!r} is {types[0].simpleString()} on the left "
                f"and {types[1].simpleString()} on the right"
            )
    return left.join(right, on=keys, how="inner")


def attach_lookup(
    df: DataFrame,
    rows: Iterable[Sequence],
    schema: str | StructType,
    on: str | Sequence[str],
) -> DataFrame:
    """Inner join with reference rows held in the program.

    Rows of ``df`` without a reference row drop, as in any inner join. The rows
    become a local relation of known size, so Spark's own threshold decides
    whether they are broadcast.
    """
    return join_on_key(df, lookup_table(df.sparkSession, rows, schema), on)
