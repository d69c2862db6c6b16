"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = "/root/testdata/sf0.001"
# the corpus operators have their own tests in tests/llm
CORPUS = {n for n in entry.queries() if n == "pipeline" or n.startswith("op")}
QUERIES = {n: q for n, q in entry.queries().items() if n not in CORPUS}
SQL = {n: s for n, s in entry.oracle_sql().items() if n not in CORPUS}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, SF_DIR, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 36 and df.count() > 0
