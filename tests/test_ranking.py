import random
from itertools import groupby

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright import (
    hot_groups,
    load_table,
    lookup_table,
    rank_values,
    rank_values_balanced,
    rank_within,
    rank_within_balanced,
)
from framewright.operators import skew
from tests.conftest import SF_DIR, plan_of, row_set, rows

RANKS = ["rank", "dense_rank", "row_number"]


def brute_force(table, descending=True):
    """(key, value, id) rows with their three ranks, by plain sorting."""

    def place(row):
        _, value, unique = row
        lowest = value is None
        signed = 0 if lowest else value
        if descending:
            return (lowest, -signed, unique)
        return (not lowest, signed, unique)

    result = []
    by_key = sorted(table, key=lambda row: repr(row[0]))
    for _, group in groupby(by_key, key=lambda row: repr(row[0])):
        rank = dense = 0
        previous = object()
        for number, row in enumerate(sorted(group, key=place), start=1):
            if row[1] != previous:
                rank, dense, previous = number, dense + 1, row[1]
            result.append((*row, rank, dense, number))
    return sorted(result, key=repr)


def ranked(df, **options):
    df = rank_within_balanced(df, ["k"], "v", "id", **options)
    return row_set(df.select("k", "v", "id", *RANKS))


def test_ties(spark):
    table = lookup_table(
        spark, [(4, 7), (1, 9), (3, 7), (2, 9), (5, 5)], "id bigint, v bigint"
    ).withColumn("k", F.lit("a"))
    result = rank_within(table, ["k"], "v", "id").orderBy("row_number")
    assert rows(result.select("id", *RANKS)) == [
        (1, 1, 1, 1),
        (2, 1, 1, 2),
        (3, 3, 2, 3),
        (4, 3, 2, 4),
        (5, 5, 3, 5),
    ]
    assert {t for n, t in result.dtypes if n in RANKS} == {"bigint"}


def test_one_shuffle_and_one_sort_for_all_three(spark):
    documents = load_table(spark, SF_DIR, "documents")
    plan = plan_of(rank_within(documents, ["source"], "n_chars", "doc_id"), "simple")
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_dropped_ranks_are_not_computed(spark):
    documents = load_table(spark, SF_DIR, "documents")
    ranks = rank_within(documents, ["source"], "n_chars", "doc_id")
    plan = plan_of(ranks.select("doc_id", "row_number"), "simple")
    assert "rank(" not in plan
    assert "text" not in plan


def test_clashing_names_are_refused(spark):
    df = spark.range(3).selectExpr("id", "id as k", "id as rank")
    with pytest.raises(ValueError, match="rank"):
        rank_within(df, ["k"], "id", "id")
    with pytest.raises(ValueError, match="rank"):
        rank_within_balanced(df, ["k"], "id", "id")
    with pytest.raises(ValueError, match="k"):
        rank_values(df, ["k"], "id", rows="k")
    with pytest.raises(ValueError, match="_slice"):
        rank_within_balanced(spark.range(3).selectExpr("id", "id as _slice"), ["id"], "id", "id")


def test_values_carry_the_row_ranks(spark):
    documents = load_table(spark, SF_DIR, "documents").withColumn(
        "v", F.floor(F.col("n_chars") / 500)
    )
    by_value = rank_values(documents, ["source"], "v")
    by_row = (
        rank_within(documents, ["source"], "v", "doc_id")
        .groupBy("source", "v", "rank", "dense_rank")
        .agg(F.count("*").alias("n_rows"))
    )
    columns = ["source", "v", "n_rows", "rank", "dense_rank"]
    assert row_set(by_value.select(columns)) == row_set(by_row.select(columns))


def skewed_rows(seed, n=3000):
    """A third of the rows under one key, much of it one value; nulls anywhere."""
    rng = random.Random(seed)
    table = []
    for unique in range(n):
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None, "warm"])
        shape = rng.random()
        value = 50 if shape < 0.5 else None if shape < 0.6 else rng.randrange(1000)
        table.append((key, value, unique))
    rng.shuffle(table)
    return table


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("hot_rows, slice_rows", [(900, 60), (300, 7), (1, 100), (1, 1)])
def test_sliced_ranks_equal_brute_force(spark, descending, hot_rows, slice_rows):
    table = skewed_rows(hot_rows + slice_rows, n=3000 if slice_rows > 1 else 300)
    df = lookup_table(spark, table, "k string, v bigint, id bigint").repartition(5)
    result = ranked(df, descending=descending, hot_rows=hot_rows, slice_rows=slice_rows)
    assert result == brute_force(table, descending)


def test_one_value_in_the_whole_group(spark):
    table = [("k", 1, i) for i in range(500)]
    df = lookup_table(spark, table, "k string, v bigint, id bigint")
    assert ranked(df, hot_rows=10, slice_rows=20) == brute_force(table)


def test_all_null_values_and_null_key(spark):
    table = [(None, None, i) for i in range(200)] + [(None, 3, i) for i in range(200, 210)]
    df = lookup_table(spark, table, "k string, v bigint, id bigint")
    assert ranked(df, hot_rows=10, slice_rows=20) == brute_force(table)


def test_negative_zero_keys_are_one_group(spark):
    table = [(0.0 if i % 2 else -0.0, i % 7, i) for i in range(300)]
    df = lookup_table(spark, table, "k double, v bigint, id bigint")
    result = rank_within_balanced(df, ["k"], "v", "id", hot_rows=10, slice_rows=30)
    numbers = sorted(row[0] for row in rows(result.select("row_number")))
    assert numbers == list(range(1, 301))


def test_several_keys_and_text_measure(spark):
    documents = load_table(spark, SF_DIR, "documents").select(
        "doc_id", "lang", "source", F.substring("text", 1, 1).alias("initial")
    )
    keys = ["lang", "source"]
    plain = rank_within(documents, keys, "initial", "doc_id")
    sliced = rank_within_balanced(
        documents, keys, "initial", "doc_id", hot_rows=15, slice_rows=4
    )
    columns = ["doc_id", *RANKS]
    assert row_set(sliced.select(columns)) == row_set(plain.select(columns))


def test_tie_breaker_of_two_columns(spark):
    turns = load_table(spark, SF_DIR, "conversations").select("role", "conv_id", "turn")
    turns = turns.dropDuplicates().withColumn("v", F.col("conv_id") % 3)
    unique = ["conv_id", "turn"]
    plain = rank_within(turns, ["role"], "v", unique)
    sliced = rank_within_balanced(turns, ["role"], "v", unique, hot_rows=50, slice_rows=20)
    assert row_set(sliced.select(plain.columns)) == row_set(plain)


def test_slices_bound_the_rows_per_sort(spark):
    """No (slice, key) piece of a hot group comes near the whole group."""
    n = 40_000
    df = spark.range(0, n, 1, 8).select(
        F.lit("hot").alias("k"), F.lit(1).alias("v"), F.col("id")
    )
    result = rank_within_balanced(df, ["k"], "v", "id", hot_rows=1000, slice_rows=2000)
    staged = result.inputFiles()
    assert staged
    sizes = spark.read.parquet(*[f for f in staged if "/rows/" in f])
    largest = sizes.groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert largest < n / 8


def test_hot_groups(spark):
    df = spark.range(10_000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .otherwise(F.concat(F.lit("k"), F.col("id") % 100))
        .alias("k")
    )
    assert rows(hot_groups(df, ["k"], 1000)) == [("hot", 3334)]
    assert rows(hot_groups(df, ["k"], 5000)) == []
    assert rows(hot_groups(df.filter("k = 'none'"), ["k"], 1)) == []


@pytest.mark.parametrize("buckets", [2, 64, 65536])
def test_all_groups_of_the_asked_size_are_hot_and_no_other(spark, monkeypatch, buckets):
    monkeypatch.setattr(skew, "BUCKETS", buckets)
    even = spark.range(50_000).select((F.col("id") % 500).alias("k"))
    more = even.union(spark.range(20).select(F.lit(7).cast("bigint").alias("k")))
    assert hot_groups(more, ["k"], 90).count() == 500
    assert row_set(hot_groups(more, ["k"], 101)) == [(7, 120)]
    assert rows(hot_groups(more, ["k"], 121)) == []


def test_groups_sharing_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(skew, "BUCKETS", 2)
    table = [(f"k{i % 9}", i % 5, i) for i in range(400)]
    df = lookup_table(spark, table, "k string, v bigint, id bigint")
    assert ranked(df, hot_rows=1, slice_rows=30) == brute_force(table)


def test_small_groups_in_the_bucket_of_a_hot_one(spark, monkeypatch):
    """They are sliced with it, and ranked alike."""
    monkeypatch.setattr(skew, "BUCKETS", 3)
    table = [(None if i % 3 == 0 else f"k{i % 40}", i % 7, i) for i in range(600)]
    df = lookup_table(spark, table, "k string, v bigint, id bigint")
    full = skew.full_buckets(df, ["k"], 200)
    assert 1 <= full.count() < 3
    assert ranked(df, hot_rows=200, slice_rows=25) == brute_force(table)


def test_keys_that_are_equal_in_another_case(spark):
    """A collation makes `A` and `a` one group, so they must share a bucket."""
    table = [("a" if i % 2 else "A", i % 5, i) for i in range(200)]
    df = lookup_table(spark, table, "k string, v bigint, id bigint")
    df = df.withColumn("k", F.col("k").cast("string collate UTF8_LCASE"))
    assert rows(hot_groups(df, ["k"], 200).select("rows")) == [(200,)]
    ranks = rank_within_balanced(df, ["k"], "v", "id", hot_rows=150, slice_rows=30)
    expected = brute_force([("a", v, i) for _, v, i in table])
    assert row_set(ranks.select("id", *RANKS)) == sorted([r[2:] for r in expected], key=repr)


def test_sliced_ranks_read_their_input_four_times(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(n):
        seen.add(1)
        return n

    key = F.udf(noted, "bigint")(F.col("id") % 2)
    df = spark.range(0, 400, 1, 4).select(key.alias("k"), F.col("id").alias("v"), "id")
    assert rank_within_balanced(df, ["k"], "v", "id", hot_rows=100, slice_rows=50).count() == 400
    assert 0 < seen.value <= 4 * 400


def test_hot_groups_of_null_keys(spark):
    df = lookup_table(spark, [(None, i) for i in range(50)] + [("a", 0)], "k string, v int")
    assert rows(hot_groups(df, ["k"], 20)) == [(None, 50)]


def test_names_in_another_case_and_with_dots(spark, tmp_path):
    taken = spark.range(3).selectExpr("id", "id as k", "id as RANK")
    for form in (rank_within, rank_within_balanced):
        with pytest.raises(ValueError, match="rank"):
            form(taken, ["k"], "id", "id")
    dotted = spark.range(60).selectExpr("id as `i.d`", "id % 2 as `k.1`", "id % 7 as `v.1`")
    plain = rank_within(dotted, ["k.1"], "v.1", "i.d")
    folder = str(tmp_path)
    sliced = rank_within_balanced(
        dotted, ["k.1"], "v.1", "i.d", hot_rows=10, slice_rows=5, folder=folder
    )
    assert row_set(sliced.select(*(f"`{c}`" for c in plain.columns))) == row_set(plain)
    assert list(tmp_path.iterdir())
    assert rank_values(dotted, ["k.1"], "v.1").count() == 14


def test_without_hot_groups_the_plan_is_the_plain_one(spark):
    documents = load_table(spark, SF_DIR, "documents")
    plan = plan_of(rank_within_balanced(documents, ["source"], "n_chars", "doc_id"), "simple")
    assert plan.count("Exchange") == 1 and "Union" not in plan


@settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    values=st.lists(
        st.tuples(st.sampled_from(["a", None]), st.none() | st.integers(-3, 3)), max_size=60
    ),
    slice_rows=st.integers(1, 10),
)
def test_rank_properties(spark, values, slice_rows):
    table = [(k, v, i) for i, (k, v) in enumerate(values)]
    df = lookup_table(spark, table, "k string, v bigint, id bigint")
    result = ranked(df, hot_rows=1, slice_rows=slice_rows)
    assert result == brute_force(table)
    assert all(dense <= rank <= number for *_, rank, dense, number in result)


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("slice_values", [1, 7, 100, 10**6])
def test_value_ranks_in_slices_equal_plain_ones(spark, descending, slice_values):
    rng = random.Random(slice_values)
    table = [
        (rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(90)]))
        for _ in range(400 if slice_values > 1 else 60)
    ]
    df = lookup_table(spark, table, "k string, v bigint")
    plain = rank_values(df, ["k"], "v", descending)
    sliced = rank_values_balanced(df, ["k"], "v", descending, slice_values=slice_values)
    assert sliced.columns == plain.columns and sliced.dtypes == plain.dtypes
    assert row_set(sliced) == row_set(plain)


def test_value_ranks_of_doubles_and_of_nothing(spark):
    nan, inf = float("nan"), float("inf")
    table = [(v,) for v in [0.0, -0.0, nan, nan, inf, -inf, None, 1.5] * 3]
    df = lookup_table(spark, table, "v double").withColumn("k", F.lit(1))
    plain = map(repr, row_set(rank_values(df, ["k"], "v")))
    sliced = map(repr, row_set(rank_values_balanced(df, ["k"], "v", slice_values=2)))
    assert list(sliced) == list(plain)
    assert rows(rank_values_balanced(df.limit(0), ["k"], "v", slice_values=2)) == []


def test_value_ranks_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(n):
        seen.add(1)
        return n

    once = F.udf(noted, "bigint")
    df = spark.range(0, 300, 1, 3).select(F.lit("k").alias("k"), once("id").alias("v"))
    ranked_once = rank_values_balanced(df, ["k"], "v", slice_values=40)
    assert ranked_once.agg(F.max("rank")).first()[0] == 300
    assert seen.value == 300
