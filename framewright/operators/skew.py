"""Finding the groups that are too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.names import column

# Keys are counted by hash bucket, which bounds the rows that a task sends into the
# shuffle. Average buckets stay below 20 million rows up to 2 * 10^13 rows.
BUCKETS = 1 << 20


def bucket_of(df: DataFrame, keys: Sequence[str]) -> Column:
    """The hash bucket of a group; equal keys, nulls too, always have the same one.

    Keys whose collation lets different strings be equal are left out of the hash.
    """
    hashed = [
        column(key)
        for key in keys
        if "collate" not in df.select(column(key)).schema[0].dataType.simpleString()
    ]
    return F.pmod(F.xxhash64(*(hashed or [F.lit(0)])), F.lit(BUCKETS)).cast("int")


def full_buckets(
    df: DataFrame, keys: Sequence[str], min_rows: int, bucket: str = "bucket", rows: str = "rows"
) -> DataFrame:
    """The hash buckets of ``keys`` with at least ``min_rows`` rows, and how many.

    A bucket never shows fewer rows than one of its groups has, so every group of
    that size is in one of these. The counts are combined in each task first, and at
    most one bucket for every ``min_rows`` rows of the table comes back.
    """
    marked = df.select(bucket_of(df, keys).alias(bucket))
    return marked.groupBy(bucket).agg(F.count("*").alias(rows)).filter(column(rows) >= min_rows)


def hot_groups(df: DataFrame, keys: Sequence[str], min_rows: int, rows: str = "rows") -> DataFrame:
    """The groups of ``keys`` with at least ``min_rows`` rows, and how many.

    Exact at any table size: only the keys of full buckets are counted one by one. At
    most one group for every ``min_rows`` rows of the table comes back. Both counts
    are combined in each task first.
    """
    full = full_buckets(df, keys, min_rows, "__bucket").select("__bucket")
    marked = df.select(*map(column, keys), bucket_of(df, keys).alias("__bucket"))
    within = marked.join(full, "__bucket", "left_semi")
    counts = within.groupBy(*map(column, keys)).agg(F.count("*").alias(rows))
    return counts.filter(column(rows) >= min_rows)
