import pytest
from oracle import comparable, connect

from lodestar.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert comparable(QUERIES[name](spark, sf).toPandas()) == comparable(connect(sf).execute(ORACLES[name]).df())


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
