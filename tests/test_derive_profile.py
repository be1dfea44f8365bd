import math
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright import exact_avg, filter_derive, lookup_table, profile, wide_sum
from tests.conftest import row_set, rows

SMALL = [("a", 1), ("a", None), ("b", 5), (None, 7), (None, 9)]


@pytest.fixture(scope="module")
def small(spark):
    return lookup_table(spark, SMALL, "k string, v bigint")


def test_null_condition_drops_the_row(small):
    assert row_set(filter_derive(small, F.col("v") > 1)) == row_set(
        small.filter("v in (5, 7, 9)")
    )


def test_output_order_and_types(small):
    result = filter_derive(small, keep=["v"], derived={"tenth": F.col("v") * 0.1})
    assert result.dtypes == [("v", "bigint"), ("tenth", "double")]


def test_shadowing_is_refused(small):
    with pytest.raises(ValueError, match="shadow"):
        filter_derive(small, derived={"v": F.lit(1)})


def test_shadowing_in_another_case_is_refused(small):
    with pytest.raises(ValueError, match="V"):
        filter_derive(small, derived={"V": F.lit(1)})
    with pytest.raises(ValueError, match="shadow"):
        filter_derive(small, keep=["k"], derived={"x": F.lit(1), "X": F.lit(2)})


def test_names_with_dots(spark):
    table = lookup_table(spark, [("a", 2)], "`k.1` string, `v.1` bigint")
    assert rows(filter_derive(table, keep=["v.1"], derived={"w.1": F.lit(1)})) == [(2, 1)]
    result = profile(table, ["k.1"], {"v.1": ["sum", "wide_sum", "exact_avg"]})
    assert rows(result) == [("a", 1, 2, Decimal(2), 2.0)]


def test_groups_keep_a_null_key_and_ignore_null_values(small):
    result = profile(small, ["k"], {"v": ["avg", "min", "max", "sum"]})
    assert row_set(result) == sorted(
        [("a", 2, 1.0, 1, 1, 1), ("b", 1, 5.0, 5, 5, 5), (None, 2, 8.0, 7, 9, 16)],
        key=repr,
    )
    assert dict(result.dtypes)["sum_v"] == "bigint"


def test_empty_input(small):
    empty = small.filter("v > 100")
    assert rows(profile(empty, ["k"], {"v": "sum"})) == []
    assert rows(
        profile(empty, measures={"v": ["sum", "avg"]}, extra={"e": exact_avg("v", 2)})
    ) == [(0, None, None, None)]


def test_unknown_measure_is_refused(small):
    with pytest.raises(ValueError, match="median"):
        profile(small, measures={"v": "median"})


def test_repeated_or_missing_output_is_refused(small):
    with pytest.raises(ValueError, match="repeat"):
        profile(small, ["k"], {"v": "sum"}, rows="k")
    with pytest.raises(ValueError, match="nothing"):
        profile(small, ["k"], rows=None)


def test_exact_avg_ignores_nulls_and_order(spark):
    cents = [(n / 100,) for n in range(1, 2001)] + [(None,)]
    forward = lookup_table(spark, cents, "price double").repartition(7)
    backward = lookup_table(spark, cents[::-1], "price double").repartition(3)
    averages = [rows(df.agg(exact_avg("price", 2)))[0][0] for df in (forward, backward)]
    assert averages == [10.005, 10.005]


def test_exact_avg_of_negative_and_finer_values(spark):
    table = lookup_table(spark, [(-1.25,), (-0.01,), (3.0,)], "price double")
    assert rows(table.agg(exact_avg("price", 2))) == [(1.74 / 3,)]
    finer = lookup_table(spark, [(0.1234,), (0.1236,)], "price double")
    assert rows(finer.agg(exact_avg("price", scale=4))) == [(0.1235,)]


@pytest.mark.parametrize("value", [0.004, 1e18, -1e300])
def test_exact_avg_refuses_what_it_would_round(spark, value):
    table = lookup_table(spark, [(1.0,), (value,)], "price double")
    with pytest.raises(Exception, match="not a multiple"):
        rows(table.agg(exact_avg("price", 2)))


@pytest.mark.parametrize("odd", [[math.nan], [math.inf], [-math.inf], [math.inf, -math.inf]])
def test_exact_avg_of_nan_and_infinities_is_that_of_avg(spark, odd):
    table = lookup_table(spark, [(v,) for v in [1.25, None, *odd]], "price double")
    ours, plain = rows(table.agg(exact_avg("price", 2), F.avg("price")))[0]
    assert repr(ours) == repr(plain)


def test_exact_avg_of_large_integers(spark):
    table = lookup_table(spark, [(2**60,), (2**60 + 2,)], "v bigint")
    assert rows(profile(table, measures={"v": "exact_avg"}, rows=None)) == [(float(2**60 + 1),)]
    with pytest.raises(ValueError, match="scales"):
        profile(table.select(F.col("v").cast("double").alias("d")), measures={"d": "exact_avg"})


def test_wide_sum_takes_whole_numbers_only(spark):
    table = lookup_table(spark, [(1.9,), (1.9,)], "v double")
    with pytest.raises(Exception, match="not a whole number"):
        rows(table.agg(wide_sum("v")))
    with pytest.raises(ValueError, match="integer column"):
        profile(table, measures={"v": "wide_sum"})


def test_exact_avg_does_not_overflow_bigint(spark):
    large = spark.range(10_000).select((F.col("id") * 0 + 9e13).alias("price"))
    # 9e13 in hundredths is 9e15; ten thousand of them exceed bigint
    assert rows(large.agg(exact_avg("price", 2))) == [(9e13,)]


def test_sums_beyond_bigint(spark):
    big = lookup_table(spark, [(2**63 - 1,)] * 3, "v bigint")
    assert rows(big.agg(wide_sum("v"))) == [(Decimal(3 * (2**63 - 1)),)]


@settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(values=st.lists(st.none() | st.integers(-(2**63), 2**63 - 1), max_size=50))
def test_wide_sum_of_any_integers(spark, values):
    table = lookup_table(spark, [(v,) for v in values], "v bigint")
    present = [v for v in values if v is not None]
    expected = Decimal(sum(present)) if present else None
    assert rows(table.agg(wide_sum("v"))) == [(expected,)]


@pytest.mark.parametrize("scale", [-1, 7])
def test_scales_beyond_the_exact_range_are_refused(scale):
    with pytest.raises(ValueError, match="scale"):
        exact_avg("price", scale)


@pytest.mark.parametrize("scale", [0, 3, 6])
def test_exact_avg_at_other_scales(spark, scale):
    values = [n / 10**scale for n in (-7, 12, 2**40 + 1)]
    table = lookup_table(spark, [(v,) for v in values], "price double")
    expected = float(Decimal(2**40 + 6).scaleb(-scale)) / 3
    assert rows(table.agg(exact_avg("price", scale))) == [(expected,)]

@settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(n=st.integers(0, 100_000))
def test_sequence_sum(spark, n):
    count, total = profile(
        spark.range(n), rows="n", extra={"total": wide_sum("id")}
    ).first()
    assert (count, total or 0) == (n, n * (n - 1) // 2)


@settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(keys=st.lists(st.none() | st.sampled_from("abc"), max_size=40))
def test_group_counts_sum_to_the_rows(spark, keys):
    table = lookup_table(spark, [(k,) for k in keys], "k string")
    counts = dict(rows(profile(table, ["k"], rows="n")))
    assert sum(counts.values()) == len(keys)
    assert counts == {k: keys.count(k) for k in set(keys)}
