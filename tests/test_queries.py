import pytest

from tests.oracle import differs
from turnwise.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert differs(spark, QUERIES[name], ORACLE_SQL[name], sf) is None


def test_entry_runs_and_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
