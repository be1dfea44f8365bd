import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from framewright import counted_preview, lookup_table, ordered, ordered_once, preview
from framewright.sources.staging import stored_and_counted
from tests.conftest import plan_of, rows

VALUES = [(1, 5), (2, None), (3, 9), (4, 5), (5, None)]


@pytest.fixture(scope="module")
def table(spark):
    return lookup_table(spark, VALUES, "id bigint, v bigint").repartition(3)


def ids(df):
    return [row[0] for row in rows(df)]


def test_descending_puts_nulls_last(table):
    assert ids(ordered(table, F.col("v").desc(), tie_breaker="id")) == [3, 1, 4, 2, 5]
    assert ids(ordered(table, "v", ascending=False, tie_breaker="id")) == [3, 1, 4, 2, 5]


def test_ascending_puts_nulls_first(table):
    assert ids(ordered(table, "v", tie_breaker="id")) == [2, 5, 1, 4, 3]


def test_several_keys(spark):
    table = lookup_table(spark, [(1, "b", 1), (2, "a", 2), (3, "a", 1)], "id int, k string, v int")
    assert ids(ordered(table, "k", "v", tie_breaker="id")) == [3, 2, 1]


def test_equal_terms_are_split_by_the_tie_breaker(spark, conf, tmp_path):
    """A value on every row must not end in one sort task."""
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    same = spark.range(0, 20_000, 1, 8).withColumn("v", F.hash("id") % 1)
    result = ordered(same, "v", tie_breaker="id")
    assert "rangepartitioning(v" in plan_of(result)
    result.write.parquet(str(tmp_path / "sorted"))
    written = spark.read.parquet(str(tmp_path / "sorted"))
    sizes = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 20_000
    assert max(sizes) < 20_000 / 4


def test_preview_is_bounded(table, capsys):
    preview(ordered(table, "v", tie_breaker="id"), rows=2)
    out = capsys.readouterr().out
    assert "only showing top 2 rows" in out
    with pytest.raises(ValueError):
        preview(table, rows=0)


def test_preview_of_a_sort_is_a_top_k(table):
    first = ordered(table, "v", tie_breaker="id").limit(2)
    plan = plan_of(first, "simple")
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_count_ignores_the_sort(table):
    counted = ordered(table, "v", tie_breaker="id").groupBy().count()
    assert "Sort" not in plan_of(counted)


def test_preview_and_count_come_from_one_run(spark, tmp_path):
    seen = tmp_path / "seen"

    def noted(n):
        with open(seen, "a") as log:
            log.write("x")
        return n

    ids_once = F.udf(noted, "bigint")
    df = spark.range(0, 500, 1, 4).select(ids_once("id").alias("id"))
    first, count = counted_preview(df, "id", tie_breaker="id", rows=3, ascending=False)
    assert [r["id"] for r in first] == [499, 498, 497] and count == 500
    assert len(seen.read_text()) == 500
    assert counted_preview(df.limit(0), "id", tie_breaker="id") == ([], 0)
    with pytest.raises(ValueError):
        counted_preview(df, "id", tie_breaker="id", rows=0)


def test_stored_rows_are_counted_by_the_run_that_writes_them(spark, tmp_path):
    table, count = stored_and_counted(spark.range(70), str(tmp_path / "rows"))
    assert count == table.count() == 70 and "Range" not in plan_of(table)
    table, count = stored_and_counted(spark.range(0), str(tmp_path / "none"))
    assert count == table.count() == 0


KINDS = {
    "n": "bigint",
    "x": "double",
    "s": "string",
    "d": "date",
    "t": "timestamp",
    "z": "timestamp_ntz",
    "m": "decimal(9,2)",
    "b": "boolean",
}


@pytest.fixture(scope="module")
def mixed_table(spark):
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    day = datetime.datetime(1965, 1, 1)
    found = []
    for i in range(600):
        n = rng.choice([None, 7, 7, 7, rng.randint(-(2**62), 2**62), rng.randint(-9, 9)])
        x = rng.choice([None, nan, inf, -inf, 0.0, -0.0, rng.gauss(0, 1), rng.gauss(0, 1e300)])
        s = rng.choice([None, "", "é", "prefix-" * 3 + str(i % 5), "".join(rng.choices("abé", k=4))])
        t = rng.choice([None, day + datetime.timedelta(hours=rng.randint(0, 10**6))])
        m = rng.choice([None, Decimal(rng.randint(-999, 999)) / 100])
        found.append((i, n, x, s, t and t.date(), t, t, m, rng.choice([None, True, False])))
    schema = "id bigint, " + ", ".join(f"{name} {kind}" for name, kind in KINDS.items())
    return spark.createDataFrame(found, schema).repartition(3)


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("terms", [*((name,) for name in KINDS), ("b", "x"), ("n", "s", "d")])
def test_one_evaluation_gives_the_same_order(mixed_table, terms, ascending):
    names = {"tie_breaker": "id", "ascending": ascending}
    wanted = [r["id"] for r in ordered(mixed_table, *terms, **names).collect()]
    found = ordered_once(mixed_table, *terms, parts=9, **names)
    assert [r["id"] for r in found.collect()] == wanted
    assert found.dtypes == mixed_table.dtypes


def test_the_input_is_evaluated_once_and_hot_values_are_cut(spark, conf):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = spark.sparkContext.accumulator(0)

    def noted(n):
        seen.add(1)
        return n

    once = F.udf(noted, "bigint")
    df = spark.range(0, 4000, 1, 4).select("id", once(F.when(F.col("id") % 3 > 0, 5)).alias("v"))
    result = ordered_once(df, "v", tie_breaker="id", parts=10)
    sizes = result.groupBy(F.spark_partition_id()).count().collect()
    assert seen.value == 4000
    assert "rangepartitioning" not in plan_of(result) and len(sizes) >= 8
    assert max(r["count"] for r in sizes) < 1000 < sum(r["count"] for r in sizes) == 4000


def test_nothing_and_bad_terms_in_order(spark):
    df = spark.createDataFrame([], "id bigint, v array<int>")
    assert ordered_once(df, "id", tie_breaker="id").collect() == []
    for bad in (lambda: ordered_once(df, tie_breaker="id"), lambda: ordered_once(df, "v", tie_breaker="id")):
        with pytest.raises(ValueError):
            bad()
