import pytest
from oracle import comparable, connect

from lodestar.plans import ORACLES, QUERIES

SLOW = {"deg_search", "fusion_search", "symphony_search", "graph_search", "ivf_rabitq_search", "vector_store_search"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got, want = comparable(QUERIES[name](spark, sf).toPandas()), comparable(con.execute(ORACLES[name]).df())
    assert got == want


def test_every_query_is_listed():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) - set(ORACLES) == SLOW | {"crc32_text"}


def test_crc_of_texts(spark, sf):
    import zlib

    from lodestar.runtime import table

    want = {r.doc_id: zlib.crc32(r.text.encode()) for r in table(spark, sf, "documents").collect()}
    assert {r.doc_id: r.crc for r in QUERIES["crc32_text"](spark, sf).collect()} == want


def test_plans_of_headline_queries(spark, sf):
    """Filters and columns reach the scan; top-k limits its groups before the shuffle; views combine before it."""
    import io
    from contextlib import redirect_stdout

    def plan(name):
        out = io.StringIO()
        with redirect_stdout(out):
            QUERIES[name](spark, sf).explain("formatted")
        return out.getvalue()

    p = plan("range_scan_between")
    assert "GreaterThanOrEqual(user_id,10)" in p and "props" not in p
    assert plan("knn_exact_topk").count("WindowGroupLimit") >= 2
    assert "partial_max_by" in plan("latest_by_key")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
