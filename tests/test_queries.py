"""Each registered query with SQL against DuckDB on the small tables."""

from pathlib import Path

import compare
import pytest

from provisio import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.oracle(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    assert compare.difference(plans.QUERIES[name](spark, SF), con, plans.SQL[name]) is None


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_item_vector_and_source_is_asked(spark, con):
    items = {r[0] for r in con.execute("select item_id from benchmark").fetchall()}
    assert items <= {r.query_id for r in plans.QUERIES["q75_hybrid_many_queries"](spark, SF).select("query_id").distinct().collect()}
    asked = {r[0] for r in con.execute("select vec_id from embeddings where vec_id % 100 = 0").fetchall()}
    assert {r.query_id for r in plans.QUERIES["q04_vector_topk_per_query"](spark, SF).collect()} == asked
    sources = dict(con.execute("select doc_id, source from documents").fetchall())
    assert len({sources[r.doc_id] for r in plans.QUERIES["q01_lexical_match"](spark, SF).collect()}) > 5


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_queries_run_over_whole_tables(name):
    assert not any(x in plans.SQL[name] for x in ("substring(text, 1, ", "item_id < ", "vec_id < ", "label < ", "'src0'", "nth <= 200"))
