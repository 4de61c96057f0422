"""Every query of the catalogue against its SQL, on the smallest tables."""

import pytest
from compare import duck, of_spark, of_sql

from graphloom.plans import catalogue, units  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, con, name):
    columns, want = of_sql(con, catalogue.SQL[name])
    got_columns, got = of_spark(catalogue.QUERIES[name](spark, SF))
    assert got_columns == columns
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_is_the_same_for_any_partitioning(spark, name):
    first = of_spark(catalogue.QUERIES[name](spark, SF))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert of_spark(catalogue.QUERIES[name](spark, SF)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
