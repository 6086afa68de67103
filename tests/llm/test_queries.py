import pytest

from affinity.llm.queries import QUERIES, SQL
from tests.oracle import FOLDER, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs_over_its_tables(spark, name):
    got = QUERIES[name](spark, FOLDER)
    rows = got.collect()
    assert rows and len(rows) == len(set(rows))


def test_leaks_equal_the_brute_force(spark, con):
    from affinity.llm.leakage import words

    grams = {}
    for i, t in con.sql("SELECT item_id, text FROM eval_items").fetchall():
        w = words(t or "")
        for j in range(len(w) - 12):
            grams.setdefault(tuple(w[j : j + 13]), set()).add(i)
    expected = {
        (d, i)
        for d, t in con.sql("SELECT doc_id, text FROM documents").fetchall()
        for w in [words(t or "")]
        for j in range(len(w) - 12)
        for i in grams.get(tuple(w[j : j + 13]), ())
    }
    assert {tuple(r) for r in QUERIES["p7_found"](spark, FOLDER).collect()} == expected
