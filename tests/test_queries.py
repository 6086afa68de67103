import pytest

from affinity.queries import CORE
from tests.oracle import FOLDER, assert_same, connection

QUERIES = {n: q for m in CORE for n, q in m.QUERIES.items()}
SQL = {n: t for m in CORE for n, t in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    if name not in SQL:
        assert QUERIES[name](spark, FOLDER).count() > 0
        return
    assert_same(spark, con, QUERIES[name], SQL[name])


def test_entry_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
