"""Ranks within groups: rank, dense rank and row number.

Four forms, by what the groups look like:

``rank_values``
    Ranks per distinct value, from pre-aggregated counts. The shuffle carries
    values, not rows.
``rank_values_balanced``
    The same result for groups of any number of distinct values: the counts are
    cut into ordered slices.
``rank_within``
    Ranks per row, one shuffle and one sort. Each group is sorted in one task.
``rank_within_balanced``
    The same result for groups of any size: groups too large for one task are
    cut into ordered slices.

All ranks are bigint columns. Within one task Spark counts ranks in int, so
``rank_within`` is for groups below 2^31 rows, as is any group that one task can
sort; the balanced form adds bigint offsets to slices and has no such limit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.names import column, repeated_names, shared_names
from framewright.operators.skew import bucket_of, full_buckets
from framewright.sources.staging import staging_folder, stored, stored_and_counted

HOT_ROWS = 20_000_000
SLICE_ROWS = 10_000_000
SLICE_VALUES = 10_000_000


@dataclass(frozen=True)
class RankNames:
    """Output column names."""

    rank: str = "rank"
    dense_rank: str = "dense_rank"
    row_number: str = "row_number"


def _directed(by: str, descending: bool) -> Column:
    return column(by).desc() if descending else column(by).asc()


def _columns(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _refuse_clashes(df: DataFrame, taken: Sequence[str], new: Sequence[str]) -> None:
    """Added columns must be new: Spark would replace or repeat them silently."""
    clashes = shared_names(df, taken, new) + repeated_names(df, new)
    if clashes:
        raise ValueError(f"output names clash: {clashes}")


def _refs(names: Sequence[str]) -> list[Column]:
    return [column(name) for name in names]


def rank_values(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    descending: bool = True,
    rows: str = "n_rows",
    names: RankNames = RankNames(),
) -> DataFrame:
    """One row per group and distinct ``by`` value, with its count and ranks.

    Rank and dense rank are the same for all rows that tie, so counting the ties
    first loses nothing, and a value repeated many times leaves each task as one
    row. Fits measures with far fewer values than rows: a group's distinct values
    are ordered in one task. ``rank_values_balanced`` is for groups with more of
    them than a task can order.
    """
    return _rank_counted(_counted_values(df, keys, by, rows, names), keys, by, descending, rows, names)


def _counted_values(
    df: DataFrame, keys: Sequence[str], by: str, rows: str, names: RankNames
) -> DataFrame:
    _refuse_clashes(df, [*keys, by], [rows, names.rank, names.dense_rank])
    return df.groupBy(*_refs(keys), column(by)).agg(F.count("*").alias(rows))


def _rank_counted(
    counted: DataFrame,
    keys: Sequence[str],
    by: str,
    descending: bool,
    rows: str,
    names: RankNames,
) -> DataFrame:
    """Ranks of distinct values from how many rows each has."""
    order = Window.partitionBy(*_refs(keys)).orderBy(_directed(by, descending))
    so_far = F.sum(column(rows)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumns(
        {
            names.rank: so_far - column(rows) + 1,
            names.dense_rank: F.row_number().over(order).cast("bigint"),
        }
    )


def rank_values_balanced(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    descending: bool = True,
    rows: str = "n_rows",
    names: RankNames = RankNames(),
    slice_values: int = SLICE_VALUES,
    folder: str | None = None,
) -> DataFrame:
    """``rank_values`` for groups with any number of distinct values.

    Not lazy: the counts of the distinct values are written once, below ``folder``
    (the session's checkpoint directory if ``None``). With more than ``slice_values``
    of them they are cut by range of key and value into slices of about that many,
    also inside a group. Prefix sums then go in two levels: of the counts within each
    slice, and of whole slices, of which a group has few rows.

    ``df`` is read once. The written rows are needed until the result has been computed.
    """
    reserved = [c for c in (*keys, by, rows) if c.startswith("_")]
    if reserved:
        raise ValueError(f"rename columns with a leading underscore: {reserved}")
    place = staging_folder(df.sparkSession, "value-slices", folder)
    counted, total = stored_and_counted(
        _counted_values(df, keys, by, rows, names), f"{place}/counts"
    )
    if total <= slice_values:
        return _rank_counted(counted, keys, by, descending, rows, names)
    ranged = counted.repartitionByRange(
        math.ceil(total / slice_values), *_refs(keys), _directed(by, descending)
    )
    # written, as the cut depends on a sample and offsets must see the same one
    sliced = stored(ranged.withColumn("_slice", F.spark_partition_id()), f"{place}/slices")
    pieces = sliced.groupBy("_slice", *_refs(keys)).agg(
        F.sum(column(rows)).alias("_rows"), F.count("*").alias("_values")
    )
    earlier = Window.partitionBy(*_refs(keys)).orderBy("_slice")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        F.col("_slice").alias("_offset_slice"),
        *(column(key).alias(f"_offset_{key}") for key in keys),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_values").over(earlier), F.lit(0)).alias("_values_before"),
    )
    offsets = stored(offsets, f"{place}/offsets")
    same = F.col("_slice") == F.col("_offset_slice")
    for key in keys:
        same &= column(key).eqNullSafe(column(f"_offset_{key}"))
    local = _rank_counted(sliced, ["_slice", *keys], by, descending, rows, names)
    return local.join(offsets, same).select(
        *_refs([*keys, by, rows]),
        (F.col("_rows_before") + column(names.rank)).alias(names.rank),
        (F.col("_values_before") + column(names.dense_rank)).alias(names.dense_rank),
    )


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie_breaker: str | Sequence[str],
    descending: bool = True,
    names: RankNames = RankNames(),
) -> DataFrame:
    """Add rank, dense rank and row number of ``by`` within each group.

    Ties share a rank and a dense rank; the ``tie_breaker``, one or more columns
    that are unique together, orders them ascending for the row number. The row
    number is computed first, because its order begins with the order of the
    ranks: one sort then serves all three. Ranks a later ``select`` drops are not
    computed.
    """
    _refuse_clashes(df, df.columns, [names.rank, names.dense_rank, names.row_number])
    group = Window.partitionBy(*_refs(keys))
    ties = group.orderBy(_directed(by, descending))
    unique = group.orderBy(_directed(by, descending), *_refs(_columns(tie_breaker)))
    return df.withColumn(
        names.row_number, F.row_number().over(unique).cast("bigint")
    ).withColumns(
        {
            names.rank: F.rank().over(ties).cast("bigint"),
            names.dense_rank: F.dense_rank().over(ties).cast("bigint"),
        }
    )


def rank_within_balanced(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie_breaker: str | Sequence[str],
    descending: bool = True,
    names: RankNames = RankNames(),
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
    folder: str | None = None,
) -> DataFrame:
    """``rank_within`` for groups of any size, for instance a third of all rows.

    Not lazy: rows are first counted by hash bucket of their keys. A bucket shows at
    least the rows of each of its groups, so without one of ``hot_rows`` rows no group
    has as many, and this is ``rank_within``. The rows of such buckets, hot groups and
    the few others that share a bucket with one, are written once below ``folder``
    (the session's checkpoint directory if ``None``), cut by range into slices of
    about ``slice_rows`` rows, so that each task sorts one slice. Every row of every
    group is ranked either way, and exactly. The written rows are needed until the
    result has been computed; whoever names the folder may then remove it.

    ``df`` is read for the buckets, for the bounds of slices, for the slices and for
    the other rows, and all its columns are written: select the needed ones before,
    and store an expensive result.
    """
    _refuse_clashes(df, df.columns, [names.rank, names.dense_rank, names.row_number])
    reserved = [column for column in df.columns if column.startswith("_")]
    if reserved:
        raise ValueError(f"rename columns with a leading underscore: {reserved}")
    place = staging_folder(df.sparkSession, "rank-slices", folder)
    # few rows of known size, so Spark can choose to broadcast them
    full = stored(full_buckets(df, keys, hot_rows, "_full", "_rows"), f"{place}/buckets")
    total = full.agg(F.sum("_rows")).first()[0]
    if not total:
        return rank_within(df, keys, by, tie_breaker, descending, names)
    within = bucket_of(df, keys) == F.col("_full")
    ordinary = rank_within(
        df.join(full, within, "left_anti"), keys, by, tie_breaker, descending, names
    )
    sliced = _rank_in_slices(
        df.join(full, within, "left_semi"),
        keys,
        by,
        tie_breaker,
        descending,
        names,
        slices=math.ceil(total / slice_rows),
        folder=place,
    )
    return ordinary.unionByName(sliced)


def _rank_in_slices(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    tie_breaker: str | Sequence[str],
    descending: bool,
    names: RankNames,
    slices: int,
    folder: str,
) -> DataFrame:
    """Rank inside each range slice, then shift by what earlier slices hold.

    The range bounds come from a sample and differ between evaluations. Writing
    the slices fixes them: the offsets and the ranks read the same cut, also
    after an executor is lost.
    """
    ranged = df.repartitionByRange(
        slices, *_refs(keys), _directed(by, descending), *_refs(_columns(tie_breaker))
    )
    staged = stored(ranged.withColumn("_slice", F.spark_partition_id()), f"{folder}/rows")
    # one row for each slice of each group; with its size known from the files, Spark
    # decides whether to broadcast it
    offsets = stored(_slice_offsets(staged, keys, by, descending), f"{folder}/offsets")
    offsets = offsets.select(
        F.col("_slice").alias("_offset_slice"),
        *(column(key).alias(f"_offset_{key}") for key in keys),
        "_rows_before",
        "_values_before",
        "_head_rank",
    )

    local = rank_within(
        staged, ["_slice", *keys], by, tie_breaker, descending, names
    )
    same_piece = F.col("_slice") == F.col("_offset_slice")
    for key in keys:
        same_piece &= column(key).eqNullSafe(column(f"_offset_{key}"))
    rank = column(names.rank)
    return local.join(offsets, same_piece).select(
        *_refs(df.columns),
        (F.col("_rows_before") + column(names.row_number)).alias(names.row_number),
        F.when(rank == 1, F.col("_head_rank"))
        .otherwise(F.col("_rows_before") + rank)
        .alias(names.rank),
        (F.col("_values_before") + column(names.dense_rank)).alias(names.dense_rank),
    )


def _slice_offsets(
    staged: DataFrame, keys: Sequence[str], by: str, descending: bool
) -> DataFrame:
    """Rows, distinct values and the rank of the first value before each piece.

    A piece is the part of one group in one slice. A run of ties may go on over
    several pieces; its rank is set where it starts, and its value counts once.
    """
    # nulls compare as the lowest value, as they sort in both directions
    value = F.struct(column(by).isNotNull().alias("present"), column(by).alias("value"))
    first, last = (F.max, F.min) if descending else (F.min, F.max)
    last_by = F.min_by if descending else F.max_by
    pieces = (
        staged.groupBy("_slice", *_refs(keys), column(by))
        .agg(F.count("*").alias("_ties"))
        .groupBy("_slice", *_refs(keys))
        .agg(
            F.sum("_ties").alias("_rows"),
            F.count("*").alias("_values"),
            first(value).alias("_head"),
            last(value).alias("_tail"),
            last_by("_ties", value).alias("_tail_rows"),
        )
    )
    order = Window.partitionBy(*_refs(keys)).orderBy("_slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    same_tail = Window.partitionBy(*_refs(keys), "_tail")

    pieces = pieces.withColumns(
        {
            "_rows_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
            "_continues": F.lag("_tail").over(order).eqNullSafe(F.col("_head")),
        }
    )
    tail_rank = F.col("_rows_before") + F.col("_rows") - F.col("_tail_rows") + 1
    pieces = pieces.withColumn("_tail_start", F.min(tail_rank).over(same_tail))
    repeated = F.sum(F.col("_continues").cast("bigint")).over(upto)
    return pieces.select(
        "_slice",
        *_refs(keys),
        "_rows_before",
        (F.coalesce(F.sum("_values").over(before), F.lit(0)) - repeated).alias(
            "_values_before"
        ),
        F.when(F.col("_continues"), F.lag("_tail_start").over(order))
        .otherwise(F.col("_rows_before") + 1)
        .alias("_head_rank"),
    )
