import contextlib
import io
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from framewright import RECOMMENDED_SETTINGS, lookup_table, obtain_session  # noqa: E402
from tests import fixed_inputs  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    settings = {
        **RECOMMENDED_SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="framewright-tests-"),
        "spark.driver.memory": "4g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    session = obtain_session("framewright-tests", "local[*]", settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def employees(spark):
    return lookup_table(spark, fixed_inputs.EMPLOYEES, fixed_inputs.EMPLOYEES_SCHEMA)


@pytest.fixture(scope="session")
def projects(spark):
    return lookup_table(spark, fixed_inputs.PROJECTS, fixed_inputs.PROJECTS_SCHEMA)


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    changed = {}

    def set_option(name, value):
        changed.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield set_option
    for name, value in changed.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def rows(df):
    return [tuple(row) for row in df.collect()]


def row_set(df):
    return sorted(rows(df), key=repr)


def plan_of(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
