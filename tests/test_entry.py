import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tests.conftest import DATA
from talkloom.plans import registry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["session_key", "event_id", "score", "title", "last_ts"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    assert compare(registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()
