import math
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from framewright import ELSE, BandRule, arrow_bands, lookup_table, null_safe_udf
from tests.conftest import rows

EDGES = [(9,), (10,), (11,), (20,), (21,), (None,)]


@pytest.mark.parametrize(
    "compare, cuts, expected",
    [
        ("<", ((10, "a"), (20, "b")), ["a", "b", "b", "c", "c", "c"]),
        ("<=", ((10, "a"), (20, "b")), ["a", "a", "b", "b", "c", "c"]),
        (">", ((20, "a"), (10, "b")), ["c", "c", "b", "b", "a", "c"]),
        (">=", ((20, "a"), (10, "b")), ["c", "b", "b", "a", "a", "c"]),
    ],
)
def test_values_on_a_cut_and_null(spark, compare, cuts, expected):
    table = lookup_table(spark, EDGES, "v bigint")
    rule = BandRule(compare, cuts, otherwise="c")
    assert [r[0] for r in rows(table.select(rule.column("v")))] == expected
    assert [r[0] for r in rows(table.select(arrow_bands(rule)("v")))] == expected


@pytest.mark.parametrize("null_label", [None, "none"])
def test_null_labels(spark, null_label):
    rule = BandRule("<", ((10, "a"),), otherwise="b", null_label=null_label)
    table = lookup_table(spark, [(1,), (None,), (10,)], "v bigint")
    expected = [("a",), (null_label,), ("b",)]
    assert rows(table.select(rule.column("v"))) == expected
    assert rows(table.select(arrow_bands(rule)("v"))) == expected
    assert rule.labels == ("a", "b")


def test_large_integers_are_not_rounded(spark):
    edge = 2**53
    rule = BandRule(">", ((edge, "above"),), otherwise="not above", null_label=None)
    table = lookup_table(spark, [(edge,), (edge + 1,), (None,)], "v bigint")
    expected = [("not above",), ("above",), (None,)]
    assert rows(table.select(rule.column("v"))) == expected
    assert rows(table.select(arrow_bands(rule)("v"))) == expected


@pytest.mark.parametrize("compare", ["<", "<=", ">", ">="])
def test_doubles_with_nan_and_infinity(spark, compare):
    cuts = ((0.5, "a"), (2, "b")) if compare.startswith("<") else ((2, "a"), (0.5, "b"))
    rule = BandRule(compare, cuts, otherwise="c", null_label=None)
    values = [0.5, 2.0, -0.0, None, math.nan, math.inf, -math.inf]
    table = lookup_table(spark, [(v,) for v in values], "v double")
    result = rows(table.select(rule.column("v"), arrow_bands(rule)("v")))
    assert all(native == arrow for native, arrow in result)
    assert result[4][0] == ("c" if compare.startswith("<") else "a")


VALUES = {
    "tinyint": [-128, -1, 0, 2, 3, 127],
    "int": [-(2**31), 0, 2, 3, 2**31 - 1, 16777217],
    "bigint": [-(2**63), 2, 3, 2**53, 2**53 + 1, 16777217, 2**63 - 1],
    "float": [-0.0, 2.0, 2.5, 16777216.0, math.nan, math.inf, -math.inf],
    "double": [-0.0, 2.0, 2.5, 2.0**53, 2.0**53 + 2, math.nan, math.inf, -math.inf],
    "decimal(20,2)": [Decimal("2.00"), Decimal("2.50"), Decimal("16777217.00"), Decimal("-3.25")],
}


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("cut", [2, 2.5, 16777217, 2**53 + 1, 1e18])
@pytest.mark.parametrize("compare", ["<", "<=", ">", ">="])
def test_native_equals_arrow_across_types(spark, kind, cut, compare):
    rule = BandRule(compare, ((cut, "a"),), otherwise="b", null_label=None)
    table = lookup_table(spark, [(v,) for v in [*VALUES[kind], None]], f"v {kind}")
    found = rows(table.select("v", rule.column("v"), arrow_bands(rule)("v")))
    assert [(v, n) for v, n, _ in found if n != _] == []


@pytest.mark.parametrize(
    "arguments",
    [
        ("==", ((1, "a"),)),
        ("<", ()),
        ("<", ((2, "a"), (1, "b"))),
        (">", ((1, "a"), (2, "b"))),
        (">=", ((1, "a"), (1, "b"))),
    ],
)
def test_bad_rules_are_refused(arguments):
    with pytest.raises(ValueError):
        BandRule(*arguments, otherwise="c")


def test_plain_function_never_sees_none(spark):
    def parity(n):
        return "odd" if n % 2 else "even"

    table = lookup_table(spark, [(1,), (None,), (2,)], "v bigint")
    assert rows(table.select(null_safe_udf(parity)("v"))) == [("odd",), (None,), ("even",)]


def test_return_type_can_be_chosen(spark):
    double = null_safe_udf(lambda n: n * 2, "bigint")
    result = spark.range(3).select(double("id").alias("twice"))
    assert result.dtypes == [("twice", "bigint")]
    assert rows(result) == [(0,), (2,), (4,)]


def test_function_is_called_once_for_each_distinct_value_of_a_batch(spark, tmp_path):
    calls = tmp_path / "calls"

    def noted(n):
        with open(calls, "a") as log:
            log.write(f"{n}\n")
        return n % 2 == 0

    df = spark.range(0, 5000, 1, 1).withColumn("v", F.when(F.col("id") % 9 > 0, F.col("id") % 7))
    made = df.select("v", null_safe_udf(noted, "boolean")("v").alias("even"))
    assert all((e is None) if v is None else (e == (v % 2 == 0)) for v, e in rows(made))
    assert sorted(calls.read_text().split()) == list("0123456")


def test_functions_of_lists_and_of_nothing_but_nulls(spark):
    length = null_safe_udf(len, "int")
    table = lookup_table(spark, [([1, 2],), (None,), ([],)], "v array<int>")
    assert rows(table.select(length("v"))) == [(2,), (None,), (0,)]
    assert rows(lookup_table(spark, [(None,)], "v string").select(length("v"))) == [(None,)]


def chain(rule, value):
    """The rule as one condition after the other."""
    if value is None:
        return rule.label_of_null
    return next((label for cut, label in rule.cuts if rule.holds(value, cut)), rule.otherwise)


@settings(
    max_examples=12,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    cuts=st.lists(st.integers(-40, 40), min_size=1, max_size=40, unique=True),
    compare=st.sampled_from(["<", "<=", ">", ">="]),
    null_label=st.sampled_from([ELSE, None, "nothing"]),
)
def test_tree_of_conditions_equals_the_chain(spark, cuts, compare, null_label):
    cuts = sorted(cuts, reverse=compare.startswith(">"))
    rule = BandRule(compare, tuple((c, f"at {c}") for c in cuts), "else", null_label)
    table = lookup_table(spark, [(v,) for v in [*range(-42, 43), None]], "v bigint")
    for value, label in rows(table.select("v", rule.column("v"))):
        assert label == chain(rule, value)


def test_many_cuts_nest_by_their_logarithm():
    rule = BandRule("<", tuple((c, str(c)) for c in range(1000)), "else")
    text, depth, deepest = str(rule.column("v")), 0, 0
    for sign in text:
        depth += (sign == "(") - (sign == ")")
        deepest = max(deepest, depth)
    assert text.count("WHEN") == 1000 and deepest < 60


@settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(values=st.lists(st.none() | st.integers(-(2**63), 2**63 - 1), max_size=60))
def test_native_equals_arrow(spark, values):
    rule = BandRule(">=", ((1000, "High"), (0, "Mid")), otherwise="Low", null_label=None)
    table = lookup_table(spark, [(v,) for v in values], "v bigint")
    result = rows(table.select("v", rule.column("v"), arrow_bands(rule)("v")))
    for value, native, arrow in result:
        expected = value if value is None else "High" if value >= 1000 else "Mid" if value >= 0 else "Low"
        assert native == arrow == expected
