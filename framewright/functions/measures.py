"""Aggregates whose result does not depend on the order of addition."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# An integer is added in three parts of at most 22 bits. Each addition stays a
# primitive one, several times faster than adding decimals, and no part can
# overflow on fewer than 2^41 rows, whatever the values.
_PART_BITS = 22


def _exact_sum(units: Column) -> Column:
    """Sum of a bigint column as ``decimal(38,0)``."""
    mask = 2**_PART_BITS - 1
    parts = [
        units.bitwiseAND(mask),
        F.shiftright(units, _PART_BITS).bitwiseAND(mask),
        F.shiftright(units, 2 * _PART_BITS),
    ]
    low, middle, high = (F.sum(part).cast("decimal(19,0)") for part in parts)
    middle_unit, high_unit = (
        F.lit(Decimal(2 ** (i * _PART_BITS))) for i in (1, 2)
    )
    return (high * high_unit + middle * middle_unit + low).cast("decimal(38,0)")


def exact_avg(column: str, scale: int) -> Column:
    """Average of a money-like double column, the same on every run.

    Adding doubles in another order changes the last digits, and a shuffle does
    not fix the order. The values are added as whole units of ``10^-scale`` and
    divided once at the end. A value with finer digits, or of more than 2^53
    units, which a double can't tell apart, ends the query. Nulls are ignored;
    no value gives null; NaN and infinities give what ``avg`` gives.
    """
    if not 0 <= scale <= 6:
        raise ValueError("scale must be from 0 to 6")
    value = F.col(column).cast("double")
    odd = F.isnan(value) | (F.abs(value) == float("inf"))
    scaled = F.rint(value * 10**scale)
    on_grid = (F.abs(scaled) <= 2.0**53) & (scaled / 10**scale == value)
    refusal = F.raise_error(
        F.concat(F.lit(f"not a multiple of 10^-{scale} within 2^53 units: "), value.cast("string"))
    )
    # a null or odd value takes no branch that would look at its units
    units = F.when(value.isNull() | odd, F.lit(None).cast("bigint")).when(
        on_grid, scaled.cast("bigint")
    ).otherwise(refusal.cast("bigint"))
    total = _exact_sum(units) * F.lit(Decimal(1).scaleb(-scale))
    return F.when(F.max(odd), F.avg(value)).otherwise(total.cast("double") / F.count(value))


def wide_sum(column: str) -> Column:
    """Exact integer sum as ``decimal(38,0)``, for totals beyond bigint.

    A value that isn't a whole number ends the query.
    """
    value = F.col(column)
    whole = value.cast("bigint")
    refusal = F.raise_error(F.concat(F.lit("not a whole number: "), value.cast("string")))
    checked = F.when(value.isNull() | (value == whole), whole).otherwise(refusal.cast("bigint"))
    return _exact_sum(checked)
