import pytest

from talkloom.llm import queries
from tests.compare import compare, connect
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, DATA).toPandas(), connect(DATA).execute(queries.ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
