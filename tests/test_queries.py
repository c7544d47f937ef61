"""Every query with SQL gives the same values in Spark and DuckDB on the smallest tables; the others run."""

import pytest

import __spark_entry__ as entry
import compare
from corpusmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert compare.difference(df, con, sql) == ""
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_are_pruned(spark):
    plan = registry.queries()["train_val_split"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "IsNotNull(text)" in plan
