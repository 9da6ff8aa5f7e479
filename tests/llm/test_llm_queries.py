import pytest

from docketflow.llm import queries
from tests.oracle import canonical, connect


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, data, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.SQL:
        assert canonical(got) == canonical(connect(data).execute(queries.SQL[name]).df())
    else:
        assert len(got.columns)
