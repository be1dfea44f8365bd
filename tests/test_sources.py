import pytest
from pyspark.sql import SparkSession

from framewright import load_table, lookup_table, obtain_session
from framewright.sources.staging import staging_folder
from framewright.sources.tables import TABLE_SCHEMAS, check_schema
from tests.conftest import SF_DIR, rows


@pytest.mark.parametrize("name", sorted(TABLE_SCHEMAS))
def test_every_table_loads_with_its_schema(spark, name):
    assert load_table(spark, SF_DIR, name).columns


def test_changed_schema_is_refused(spark):
    with pytest.raises(ValueError, match="quality: expected string, found int"):
        load_table(spark, SF_DIR, "labels", "doc_id bigint, quality string")
    with pytest.raises(ValueError, match="score: expected int, found nothing"):
        check_schema(spark.range(1), "score int", "ids")


def test_lookup_keeps_types_and_nulls(spark):
    table = lookup_table(spark, [(1, "a", 1.5), (None, None, 2)], "i int, s string, d double")
    assert table.dtypes == [("i", "int"), ("s", "string"), ("d", "double")]
    assert rows(table) == [(1, "a", 1.5), (None, None, 2.0)]
    assert all(field.nullable for field in table.schema)


def test_lookup_refuses_short_rows(spark):
    with pytest.raises(ValueError, match="expected 2 values"):
        lookup_table(spark, [(1,)], "a int, b int")


def test_empty_lookup(spark):
    assert lookup_table(spark, [], "a int, b string").count() == 0


def test_schema_can_be_printed(spark, employees, capsys):
    employees.printSchema()
    assert "salary: long" in capsys.readouterr().out


def test_session_is_reused_untouched(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    again = obtain_session("other", settings={"spark.sql.shuffle.partitions": "3"})
    assert again is spark is SparkSession.getActiveSession()
    assert again.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.version.startswith("4.")


def test_staging_follows_the_checkpoint_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    first, second = staging_folder(spark, "x"), staging_folder(spark, "x")
    assert first.startswith(f"{root}/x-") and first != second


class _Settings:
    """Stands in for a session where only configuration is read."""

    def __init__(self, **values):
        self.values = {name.replace("_", "."): value for name, value in values.items()}
        self.conf = self

    def get(self, name, default=None):
        return self.values.get(name, default)


def test_staging_needs_a_shared_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging_folder(_Settings(spark_master="yarn"), "x")
    shared = _Settings(spark_master="yarn", spark_checkpoint_dir="s3://bucket/ck/")
    assert staging_folder(shared, "x").startswith("s3://bucket/ck/x-")
    assert staging_folder(_Settings(spark_master="local[2]"), "x")
