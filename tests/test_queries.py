"""Every registered query of the library itself against its SQL, over the smallest tables."""

import pytest
from compare import connect, differences

from citemill.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, small, name):
    assert differences(spark, con, registry.queries()[name], SQL[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_gives_rows(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "rank", "id", "score", "dense_rank", "bm25_rank"]
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark, small):
    from pyspark.sql import functions as F

    from citemill.plans.tables import table

    df = table(spark, small, "documents").where(F.col("lang") == "en").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]
