"""Every registered query at sf0.001, compared with its check SQL where there is one."""

import os

import pytest

import __spark_entry__ as entry_module
from check import compare, connection

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# fitted models take long; one stands for all unless everything is asked for
SLOW = {n for n in QUERIES if n not in ORACLES and n[:3] in ("d9_", "d10", "d11", "d12", "d13", "d14", "d15", "d16", "d17", "d18", "s14")}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    if name in SLOW and not os.environ.get("ALL_QUERIES"):
        pytest.skip("model query; set ALL_QUERIES=1")
    result = QUERIES[name](spark, sf_dir).toArrow()
    if name in ORACLES:
        assert compare(result, duck.execute(ORACLES[name]).to_arrow_table()) == ""
    else:
        assert result.num_rows > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
