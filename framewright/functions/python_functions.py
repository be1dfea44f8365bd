"""Python scalar functions over Arrow batches.

Prefer ``BandRule.column`` where a rule can be written natively: a Python
function ends the codegen stage, and a filter on its result cannot reach the
scan.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from framewright.functions.bands import BandRule


def null_safe_udf(function: Callable, return_type: DataType | str = "string"):
    """Wrap a one-argument Python function: null in, null out, Arrow transfer.

    The function itself never sees ``None``, and must depend on its argument alone:
    each Arrow batch is dictionary-encoded and the function called on the dictionary,
    so once for each distinct value of the batch. Values of nested types, which have
    no dictionary, are passed one by one. ``arrow_bands`` needs no call at all.
    """

    def applied(column: Column | str) -> Column:
        kind = to_arrow_type(F.udf(lambda value: value, return_type).returnType)

        @F.arrow_udf(return_type)
        def batch(values: pa.Array) -> pa.Array:
            if pa.types.is_nested(values.type):
                given = values.to_pylist()
                return pa.array([None if v is None else function(v) for v in given], type=kind)
            coded = values.dictionary_encode()
            made = pa.array([function(v) for v in coded.dictionary.to_pylist()], type=kind)
            return made.take(coded.indices)

        return batch(column)

    return functools.wraps(function)(applied)


def _comparable(values: pa.Array, cut) -> tuple[pa.Array, pa.Scalar]:
    """Values and cut in the type in which Spark compares them.

    Where one is a fraction in floating point, that is double, however large an
    integer on the other side; Arrow would refuse what a double can't hold.
    """
    if pa.types.is_floating(values.type) or isinstance(cut, float):
        return values.cast(pa.float64(), safe=False), pa.scalar(float(cut), pa.float64())
    if pa.types.is_decimal(values.type):
        wide = pa.decimal256(76, values.type.scale)
        return values.cast(wide), pa.scalar(Decimal(cut))
    return values, pa.scalar(cut)


def arrow_bands(rule: BandRule):
    """A ``BandRule`` evaluated in Python, one whole Arrow batch at a time."""
    comparison = {
        "<": "less",
        "<=": "less_equal",
        ">": "greater",
        ">=": "greater_equal",
    }[rule.compare]
    cuts = [cut for cut, _ in rule.cuts]
    labels = [label for _, label in rule.cuts]
    otherwise, label_of_null = rule.otherwise, rule.label_of_null
    upward = rule.compare.startswith(">")

    @F.arrow_udf("string")
    def banded(values: pa.Array) -> pa.Array:
        sides = [_comparable(values, cut) for cut in cuts]
        holds = [pc.call_function(comparison, list(side)) for side in sides]
        if upward and pa.types.is_floating(values.type):
            # Spark orders NaN above every number, Arrow compares it as false
            holds = [pc.or_(h, pc.is_nan(values)) for h in holds]
        conditions = pa.StructArray.from_arrays(
            [pc.is_null(values), *(pc.fill_null(h, False) for h in holds)],
            names=["null", *map(str, range(len(holds)))],
        )
        branches = [label_of_null, *labels, otherwise]
        return pc.case_when(conditions, *(pa.scalar(b, pa.string()) for b in branches))

    return banded
