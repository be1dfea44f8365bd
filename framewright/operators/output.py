"""Looking at a result without pulling it to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from framewright.operators.ordering import ordered


def preview(df: DataFrame, rows: int = 20, width: int | None = None) -> None:
    """Print at most ``rows`` rows.

    Only that many rows reach the driver, and a sorted input is planned as a
    top-k per task instead of a global sort. ``width`` cuts long values.
    """
    if rows < 1:
        raise ValueError("rows must be positive")
    df.show(rows, truncate=False if width is None else width)


def counted_preview(
    df: DataFrame,
    *terms: Column | str,
    tie_breaker: str | Sequence[str],
    rows: int = 20,
    ascending: bool = True,
) -> tuple[list[Row], int]:
    """The first ``rows`` rows in order, and the number of all rows, in one run.

    A top-k has to read its whole input, so the count is observed on the way: the
    plan isn't run again for it. Only ``rows`` rows and one number reach the driver.
    Terms and tie-breaker are those of ``ordered``.
    """
    if rows < 1:
        raise ValueError("rows must be positive")
    seen = Observation("previewed rows")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    top = ordered(watched, *terms, tie_breaker=tie_breaker, ascending=ascending).limit(rows)
    return top.collect(), seen.get["rows"]
