"""Averages that don't depend on the order of addition, against exact fractions."""

import math
import random
import struct
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright import load_table, lookup_table, profile, stable_average
from tests.conftest import SF_DIR, row_set, rows


def bits(value):
    return None if value is None else struct.pack("<d", value)


def mean(values):
    """The nearest double to the mean of the values' exact sum."""
    return float(sum(map(Fraction, values)) / len(values)) if values else None


@settings(
    max_examples=15,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=40))
def test_average_is_rounded_once(spark, values):
    table = lookup_table(spark, [(v,) for v in [*values, None]], "v double")
    found = rows(stable_average(table, [], "v"))
    assert [bits(r[0]) for r in found] == [bits(mean(values))]


def test_extremes(spark):
    least, most = 5e-324, 1.7976931348623157e308
    groups = {
        "powers": [s * 2.0**k for k in range(-1074, 1024) for s in (1, -0.999)],
        "most": [most] * 3,
        "cancel": [1e308, 1.0, -1e308],
        "least": [least, least, 0.0],
        "zeros": [-0.0, 0.0],
        "near powers": [math.nextafter(2.0**k, s) for k in range(-60, 60) for s in (0, 1e300)],
    }
    table = [(k, v) for k, vs in groups.items() for v in vs]
    random.Random(1).shuffle(table)
    found = dict(rows(stable_average(lookup_table(spark, table, "k string, v double"), ["k"], "v")))
    assert {k: bits(v) for k, v in found.items()} == {k: bits(mean(vs)) for k, vs in groups.items()}


def test_nulls_infinities_and_keys(spark):
    nan, inf = float("nan"), float("inf")
    table = [("n", None), ("i", inf), ("i", 1.0), ("b", inf), ("b", -inf), ("x", nan), ("x", 2.0)]
    table += [(None, 3.0), (None, 4.0)]
    df = lookup_table(spark, table, "k string, v double")
    found = {r["k"]: r["avg_v"] for r in stable_average(df, ["k"], "v").collect()}
    assert found["n"] is None and found["i"] == inf and found[None] == 3.5
    assert math.isnan(found["b"]) and math.isnan(found["x"])
    assert rows(stable_average(df.limit(0), [], "v")) == [(None,)]
    with pytest.raises(ValueError):
        stable_average(df, ["k"], "v", "K")


def test_equal_bits_over_shuffled_copies(spark):
    """Plain averages of these differ in their last digits."""
    lines = load_table(spark, SF_DIR, "lineitem").select(
        "l_returnflag", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v")
    )
    copies = [lines.repartition(n, F.rand(seed=n)) for n in (1, 7, 23)]
    found = [row_set(stable_average(copy, ["l_returnflag"], "v")) for copy in copies]
    assert found[0] == found[1] == found[2]
    values = {}
    for key, value in rows(lines):
        values.setdefault(key, []).append(value)
    assert {k: bits(v) for k, v in found[0]} == {k: bits(mean(vs)) for k, vs in values.items()}


def test_profile_takes_it_beside_other_measures(spark):
    df = lookup_table(spark, [(None, 1.5), (None, 2.5), ("a", None)], "k string, v double")
    result = profile(df, ["k"], {"v": ["min", "stable_avg", "max"]})
    assert result.columns == ["k", "n_rows", "min_v", "stable_avg_v", "max_v"]
    assert row_set(result) == sorted(
        [(None, 2, 1.5, 2.0, 2.5), ("a", 1, None, None, None)], key=repr
    )
    assert rows(profile(df, (), {"v": "stable_avg"}, rows=None)) == [(2.0,)]
