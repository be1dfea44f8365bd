"""Averages of any doubles, the same whatever the order of addition.

Doubles are binary fractions, so their sum is exact if it is kept as integers. Values
are binned by exponent; in a bin, each is a whole number of the bin's unit, cut into
three parts of 24 bits that are added as bigints. Partial sums of any split of the rows
thus give the same bins, after a lost executor, too. The few bins of a group are put
together in whole numbers and divided once, which rounds once.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from framewright.names import column, shared_names

_BIN_BITS = 16
_PART_BITS = 24
# The lowest bit of the smallest double, and the number of bins up to the largest.
_LOWEST = -1074
_BINS = (1024 - _LOWEST) // _BIN_BITS + 1
# A unit of 2^-k is reached in two factors, as one alone may be no double.
_HALF_UNITS = [
    [2.0 ** -(part(_BIN_BITS * b + _LOWEST)) for b in range(_BINS)]
    for part in (lambda k: k // 2, lambda k: k - k // 2)
]


def _parts(value: Column) -> list[Column]:
    """The bin of a finite value, and its three parts in units of the bin.

    The logarithm may be off by one; the bin is low enough for either, and any bin
    that is low enough gives the same sum.
    """
    magnitude = F.floor(F.log2(F.abs(value))) - 53 - _LOWEST
    place = F.when(value == 0, 0).otherwise(F.greatest(F.floor(magnitude / _BIN_BITS), F.lit(0)))
    at = (place + 1).cast("int")
    first, second = (F.element_at(F.array(*map(F.lit, units)), at) for units in _HALF_UNITS)
    whole = value * first * second
    high = F.floor(whole / 2.0 ** (2 * _PART_BITS))
    rest = whole - high * 2.0 ** (2 * _PART_BITS)
    middle = F.floor(rest / 2.0**_PART_BITS)
    low = (rest - middle * 2.0**_PART_BITS).cast("bigint")
    return [at - 1, low, middle, high]


@F.arrow_udf(DoubleType())
def _quotient(bins: pa.Array) -> pa.Array:
    found = []
    for rows in bins.to_pylist():
        total = count = 0
        for row in rows or ():
            units = row["low"] + (row["middle"] << _PART_BITS) + (row["high"] << 2 * _PART_BITS)
            total += units << _BIN_BITS * row["bin"]
            count += row["rows"]
        # division of whole numbers is rounded once, to the nearest double
        found.append(total / (count << -_LOWEST) if count else None)
    return pa.array(found, pa.float64())


def stable_average(
    df: DataFrame, keys: Sequence[str], value: str, name: str | None = None
) -> DataFrame:
    """One row per key combination with ``avg_<value>``, correctly rounded.

    One row in all without keys. Nulls are ignored; no value gives null. NaN, or both
    infinities, give NaN; one infinity gives itself. Beyond 2^38 rows of a group, sums
    of a bin could leave 64 bits; Spark then ends the query.

    Rows are combined in each task before the shuffle, into one for each key and bin,
    of which a group has ``_BINS`` at most, in practice a few.
    """
    name = f"avg_{value}" if name is None else name
    if shared_names(df, keys, [name]):
        raise ValueError(f"output names clash: {name}")
    number = column(value).cast("double")
    infinite = F.abs(number) == float("inf")
    marked = df.select(
        *map(column, keys),
        F.when(~(F.isnan(number) | infinite), number).alias("__number"),
        F.when(F.isnan(number) | infinite, number).alias("__odd"),
    )
    place, low, middle, high = _parts(F.col("__number"))
    binned = marked.groupBy(*map(column, keys), place.alias("__bin")).agg(
        F.sum(low).alias("low"),
        F.sum(middle).alias("middle"),
        F.sum(high).alias("high"),
        F.count("__number").alias("rows"),
        # adding odd values gives the same in any order
        F.sum("__odd").alias("__odd"),
    )
    present = F.col("rows") > 0
    bins = F.collect_list(
        F.when(present, F.struct(F.col("__bin").alias("bin"), "low", "middle", "high", "rows"))
    )
    merged = binned.groupBy(*map(column, keys)).agg(
        bins.alias("__bins"), F.sum("__odd").alias("__odd")
    )
    return merged.select(
        *map(column, keys), F.coalesce("__odd", _quotient("__bins")).alias(name)
    )
