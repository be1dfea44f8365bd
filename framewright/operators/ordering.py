"""Global sorts for presentation."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.names import column, shared_names
from framewright.sources.staging import staging_folder, stored

# Rank error of the quantile sketch, as a share of a part.
SKETCH_ERROR = 0.02


def ordered(
    df: DataFrame,
    *terms: Column | str,
    tie_breaker: str | Sequence[str],
    ascending: bool = True,
) -> DataFrame:
    """Sort by ``terms``, then by a unique ``tie_breaker`` ascending.

    ``ascending`` gives the direction of terms passed as names; a ``Column``
    term carries its own. Nulls come first ascending and last descending.

    The tie-breaker makes the order the same on every run. It also lets the
    range partitioner split a run of equal terms: without it, a value held by a
    third of the rows would be sorted in one task.

    Spark computes the input of a global sort twice, once to sample its range
    bounds. Derive costly columns that are no sort terms after the sort, or use
    ``ordered_once``.
    """
    directed = [
        term
        if isinstance(term, Column)
        else F.col(term).asc()
        if ascending
        else F.col(term).desc()
        for term in terms
    ]
    breakers = [tie_breaker] if isinstance(tie_breaker, str) else list(tie_breaker)
    return df.orderBy(*directed, *breakers)


def ordered_once(
    df: DataFrame,
    *terms: str,
    tie_breaker: str | Sequence[str],
    ascending: bool = True,
    parts: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """``ordered`` by column names, with one evaluation of an expensive input.

    Not lazy: the rows are stored below ``folder`` (the session's checkpoint directory
    if ``None``), and while they are written a quantile sketch of the first term is
    observed, so nothing runs for the bounds alone. Rows then go to about ``parts``
    parts by these bounds (as many as shuffle partitions if ``None``) and are sorted in
    each. A value that spans several bounds is cut once more, by bounds of the next
    column among its rows, read from the stored columns.

    The sketch only balances: any bounds give the same order, that of ``ordered``. The
    first term and the next column are numbers, text, dates, timestamps or booleans.
    The stored rows are needed until the result has been computed.
    """
    breakers = [tie_breaker] if isinstance(tie_breaker, str) else list(tie_breaker)
    columns = [*terms, *breakers]
    if not terms or len(columns) < 2:
        raise ValueError("a term and a tie-breaker are needed")
    if shared_names(df, df.columns, ["_part"]):
        raise ValueError("rename the column _part")
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = _mark(df, columns[0], ascending)
    second = _mark(df, columns[1], ascending if len(terms) > 1 else True)

    seen = Observation("sort bounds")
    watched = df.observe(seen, _quantiles(first, parts).alias("marks"))
    rows = stored(watched, staging_folder(spark, "ordered", folder))
    marks = Counter(seen.get["marks"] or [])
    spans = {mark: count for mark, count in marks.items() if count > 1}
    cuts: dict[float, list[float]] = {}
    if spans:  # at most one for every two bounds
        inner = rows.filter(first.isin(list(spans))).groupBy(first.alias("mark"))
        value = column(columns[0])
        inner = inner.agg(
            _quantiles(second, parts).alias("marks"),
            F.min(value).eqNullSafe(F.max(value)).alias("alike"),
        )
        # unlike values with one mark (long texts that begin alike) stay together
        for row in inner.filter("alike").collect():
            wanted, found = spans[row["mark"]], row["marks"]
            picked = {found[len(found) * i // wanted] for i in range(wanted)}
            cuts[row["mark"]] = sorted(picked)

    number, size = _part_number(first, second, sorted(marks), cuts)
    order = [column(t).asc() if ascending else column(t).desc() for t in terms]
    dealt = rows.withColumn("_part", number).repartitionById(size, "_part")
    return dealt.sortWithinPartitions(*order, *map(column, breakers)).drop("_part")


def _mark(df: DataFrame, name: str, ascending: bool) -> Column:
    """A double that never falls along the order of a column; equal for some neighbours.

    Null and NaN have marks that no other value has.
    """
    kind, value = df.schema[name].dataType, column(name)
    if isinstance(kind, T.StringType):
        digits = F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), 1, 6)), 12, "0")
        number = F.conv(digits, 16, 10).cast("double")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(value).cast("double")
    elif isinstance(kind, T.TimestampNTZType):
        number = F.unix_micros(F.to_utc_timestamp(value.cast("timestamp"), "UTC")).cast("double")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(value).cast("double")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        number = value.cast("double")
        largest = sys.float_info.max
        number = (
            F.when(F.isnan(number), float("inf"))
            .when(number > largest, largest)
            .when(number < -largest, -largest)
            .otherwise(number)
        )
    else:
        raise ValueError(f"can't cut {kind.simpleString()} column {name!r} into ranges")
    # nulls are first ascending and last descending; 0.0 and -0.0 are one
    if ascending:
        return F.coalesce(number, F.lit(float("-inf"))) + 0.0
    return F.coalesce(-number, F.lit(float("inf"))) + 0.0


def _quantiles(mark: Column, parts: int) -> Column:
    shares = [i / parts for i in range(1, parts)] or [0.5]
    return F.percentile_approx(mark, shares, max(1000, int(parts / SKETCH_ERROR)))


def _part_number(
    first: Column, second: Column, marks: list[float], cuts: dict[float, list[float]]
) -> tuple[Column, int]:
    """The number of a row's part, by a tree of conditions, and how many there are.

    Each mark ends a part that holds it; one with cuts of its own has parts for them.
    """
    starts, size = [], 0
    for mark in marks:
        starts.append(size)
        size += 1 + (len(cuts[mark]) + 1 if mark in cuts else 0)

    def inside(own: list[float], base: int) -> Column:
        return _tree(second, own, lambda i: F.lit(base + i))

    def leaf(i: int) -> Column:
        if i == len(marks):
            return F.lit(size)
        if marks[i] not in cuts:
            return F.lit(starts[i])
        among = inside(cuts[marks[i]], starts[i] + 1)
        return F.when(first < marks[i], F.lit(starts[i])).otherwise(among)

    return _tree(first, marks, leaf).cast("int"), size + 1


def _tree(value: Column, bounds: list[float], leaf) -> Column:
    """``leaf(i)`` for the first bound that the value doesn't exceed."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return leaf(low)
        middle = (low + high) // 2
        return F.when(value <= bounds[middle], between(low, middle)).otherwise(
            between(middle + 1, high)
        )

    return between(0, len(bounds))
