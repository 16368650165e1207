import pytest
from conftest import DATA
from oracle import spark_rows, sql_rows

from shalegrid.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    sf_dir = f"{DATA}/sf0.001"
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(sf_dir, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
