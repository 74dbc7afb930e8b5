"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as jobs
import verify

FOLDER = "/root/testdata/sf0.001"
SQL = jobs.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return verify.connect(FOLDER)


@pytest.mark.parametrize("name", list(jobs.queries()))
def test_same_as_sql(spark, con, name):
    problem, _ = verify.compare(spark, con, FOLDER, name, jobs.queries()[name], SQL.get(name))
    # Some small samples have no row for a query; the larger ones do.
    assert problem is None or problem in ("both empty", "no rows"), problem


def test_every_sql_has_a_query():
    assert set(SQL) <= set(jobs.queries())


def test_entry(spark):
    df = jobs.entry(spark)
    assert df.columns == ["owner_id", "contact", "messages", "rank"] and df.count() > 0
