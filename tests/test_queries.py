"""Every registered query against its SQL, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from framewright.plans.documents import labelled_stats
from framewright.sources.tables import TABLE_SCHEMAS
from tests.conftest import SF_DIR, plan_of, rows

QUERIES = {name: entry.run for name, entry in spark_entry.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLE_SCHEMAS:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'"
        )
    yield connection
    connection.close()


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(spark_entry.oracle_sql())
    assert set(QUERIES) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(spark_entry.oracle_sql()[name])
    columns = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(columns)
    assert sorted(map(repr, rows(result.select(columns)))) == sorted(
        map(repr, expected.fetchall())
    )


@pytest.mark.parametrize("name", [n for n in QUERIES if n.endswith("_in_order")])
def test_sorted_queries_keep_the_order_of_their_sql(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(spark_entry.oracle_sql()[name])
    columns = [column[0] for column in expected.description]
    assert rows(result.select(columns)) == expected.fetchall()


def test_entry_runs(spark):
    assert spark_entry.entry(spark).count() == 39


def test_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["filter_and_derive"](spark, SF_DIR))
    assert "GreaterThan(n_chars,300)" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in plan


@pytest.mark.parametrize("name", QUERIES)
def test_no_query_scans_texts_it_does_not_use(spark, name):
    assert "text:string" not in plan_of(QUERIES[name](spark, SF_DIR))


def test_native_category_has_no_python_stage(spark):
    assert "Python" not in plan_of(QUERIES["category_native"](spark, SF_DIR))
    assert "Python" not in plan_of(QUERIES["category_in_order"](spark, SF_DIR))
    assert "ArrowEvalPython" in plan_of(QUERIES["category_udf"](spark, SF_DIR))


def test_sliced_ranks_have_slices_in_their_plan(spark):
    assert "_slice" in plan_of(QUERIES["rank_trio_sliced"](spark, SF_DIR))
    assert "_slice" not in plan_of(QUERIES["rank_trio"](spark, SF_DIR))


def test_flagship_filter_is_pushed_below_the_join(spark):
    stats = labelled_stats(spark, SF_DIR)
    plan = plan_of(stats)
    assert "GreaterThan(n_chars,300)" in plan


def test_aggregates_are_partial_before_the_shuffle(spark):
    plan = plan_of(QUERIES["line_profile"](spark, SF_DIR), "simple")
    assert plan.count("Exchange") == 1
    assert "partial_avg" in plan and "partial_min" in plan


def test_flagship_joins_and_aggregates_once(spark):
    plan = plan_of(QUERIES["flagship"](spark, SF_DIR))
    assert "documents.parquet" not in plan and "labels.parquet" not in plan


def test_value_ranks_of_large_groups_have_no_window_over_a_whole_group(spark):
    plan = plan_of(QUERIES["price_ranks_sliced"](spark, SF_DIR), "simple")
    windows = [line for line in plan.splitlines() if " Window [" in line or "Window [" in line]
    assert windows and all("_slice" in line for line in windows)
    assert "_slice" not in plan_of(QUERIES["line_ranks"](spark, SF_DIR), "simple")
