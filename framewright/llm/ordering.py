"""Global order without a single task: ranges, and counts before each range."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.batches import shuffle_width, stored


def before_each(parts: DataFrame, part: str, amount: str, name: str) -> DataFrame:
    """``part`` and the sum of ``amount`` over smaller parts: a row for each range.

    Stored, so that Spark knows its size and broadcasts it if that is small.
    """
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(amount).over(earlier), F.lit(0)).cast("bigint")
    return stored(parts.select(part, total.alias(name)), "range-starts")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add each row's place in the order, from 0 on.

    Rows are cut into ranges, sorted within them and written; a range's rows then
    start at the number of rows in earlier ranges. Rows equal in ``order`` get
    places of their own in any order: pass a unique order for repeatable places.
    """
    spark = df.sparkSession
    ranged = (
        df.repartitionByRange(shuffle_width(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    fixed = stored(ranged, "numbered")
    counts = fixed.groupBy("__part").agg(F.count("*").alias("__rows"))
    starts = before_each(counts, "__part", "__rows", "__start")
    placed = fixed.join(starts, "__part")
    return placed.select(
        *(f"`{c}`" for c in df.columns), (F.col("__start") + F.col("__row")).alias(name)
    )


def key_ranges(df: DataFrame, key: str) -> tuple[list[int], int | None]:
    """The last keys of all ranges but the top one, and the largest key.

    Quantiles of a bigint key, so about as many ranges as shuffle partitions, and
    one number of each on the driver. Each range's last key exists in ``df``.
    """
    width = shuffle_width(df.sparkSession)
    marks = [i / width for i in range(1, width)] or [0.5]
    found = df.agg(
        F.percentile_approx(key, marks, max(10_000, 20 * width)).alias("marks"),
        F.max(key).alias("top"),
    ).first()
    top = found["top"]
    return sorted({end for end in found["marks"] or [] if end < top}), top


def range_number(ends: list[int], key: Column | str) -> Column:
    """The range of a key; null keys fall into the lowest."""

    @F.arrow_udf(T.IntegerType())
    def number(keys: pa.Array) -> pa.Array:
        known = keys.fill_null(-(2**63)).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(np.array(ends, dtype=np.int64), known).astype(np.int32))

    return number(key)
