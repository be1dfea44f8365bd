"""Every operator group on small inputs with results derived by hand."""

from pyspark.sql import functions as F

from framewright import (
    REFUSE,
    BandRule,
    arrow_bands,
    filter_derive,
    join_on_key,
    null_safe_udf,
    ordered,
    pivot_measures,
    profile,
    rank_within,
    wide_sum,
)
from tests import fixed_inputs
from tests.conftest import row_set, rows

LEVEL = BandRule(">", ((90000, "Senior"),), otherwise="Junior")
CATEGORY = BandRule(
    ">=", ((100000, "High"), (80000, "Medium")), otherwise="Low", null_label=None
)
AGE_GROUP = BandRule("<", ((30, "20s"), (40, "30s")), otherwise="40s+")


def test_filter_derive_sort(employees):
    result = filter_derive(
        employees,
        F.col("age") > 30,
        keep=["name", "department", "age", "salary"],
        derived={"bonus": F.col("salary") * 0.1, "level": LEVEL.column("salary")},
    )
    result = ordered(result, F.col("salary").desc(), tie_breaker="name")
    assert rows(result) == fixed_inputs.OVER_30_BY_SALARY
    assert result.count() == 6
    assert dict(result.dtypes)["bonus"] == "double"


def test_group_statistics(employees):
    stats = profile(
        employees,
        ["department"],
        {"salary": ["avg", "min", "max"], "age": "avg"},
        rows="employee_count",
    )
    assert stats.columns == [
        "department",
        "employee_count",
        "avg_salary",
        "min_salary",
        "max_salary",
        "avg_age",
    ]
    result = ordered(stats, F.col("avg_salary").desc(), tie_breaker="department")
    assert rows(result) == fixed_inputs.DEPARTMENTS_BY_AVG_SALARY


def test_inner_join(employees, projects):
    joined = join_on_key(employees, projects, on="id")
    assert joined.columns == employees.columns + projects.columns[1:]
    result = joined.select(
        "name", "department", "project_name", "completion_percentage", "salary"
    )
    assert row_set(result) == fixed_inputs.WITH_PROJECTS


def test_ranks(employees):
    ranked = rank_within(employees, ["department"], "salary", "id")
    result = ordered(ranked, "department", "rank", tie_breaker="id")
    result = result.select("department", "name", "rank", "dense_rank", "row_number")
    assert rows(result) == fixed_inputs.RANKS_BY_DEPARTMENT


def test_category_in_three_forms(employees):
    cuts, lowest = CATEGORY.cuts, CATEGORY.otherwise

    def category(salary):
        return next((label for cut, label in cuts if salary >= cut), lowest)

    forms = [
        CATEGORY.column("salary"),
        arrow_bands(CATEGORY)("salary"),
        null_safe_udf(category)("salary"),
    ]
    for form in forms:
        result = employees.withColumn("category", form)
        result = result.select("name", "salary", "category")
        result = ordered(result, "salary", ascending=False, tie_breaker="name")
        assert rows(result) == fixed_inputs.CATEGORIES_BY_SALARY


def test_pivot(employees):
    banded = employees.withColumn("age_group", AGE_GROUP.column("age"))
    result = pivot_measures(
        banded,
        ["department"],
        "age_group",
        {"20s": "under_30", "30s": "under_40", "40s+": "from_40"},
        {"avg_salary": F.avg("salary"), "count": F.count(F.lit(1))},
        other=REFUSE,
    )
    assert result.columns == [
        "department",
        "under_30_avg_salary",
        "under_30_count",
        "under_40_avg_salary",
        "under_40_count",
        "from_40_avg_salary",
        "from_40_count",
    ]
    assert row_set(result) == fixed_inputs.AGE_GROUP_PIVOT


def test_integer_sequence(spark):
    ids = spark.range(100)
    assert ids.count() == 100
    assert profile(ids, measures={"id": "sum"}, rows=None).first()[0] == 4950
    assert ids.agg(wide_sum("id")).first()[0] == 4950
    assert [spark.range(n).count() for n in (10, 5)] == [10, 5]
