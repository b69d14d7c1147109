"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from compare import differences, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(entry.queries()) - set(entry.corpus_queries()) - set(entry.oracle_sql()) == set()


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql() and n not in entry.corpus_queries()])
def test_query(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_export_sees_only_its_own_tables(spark):
    spark.range(2).createOrReplaceTempView("mart_unrelated")
    try:
        assert entry.queries()["mart_export"](spark, SF).count() == 3
    finally:
        spark.catalog.dropTempView("mart_unrelated")
    assert not [t.name for t in spark.catalog.listTables() if t.isTemporary and "mart_" in t.name]
