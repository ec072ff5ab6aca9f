import pytest

from compare import canon, connect
from corvane.plans import queries as plans


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_gives_what_its_sql_gives(spark, data, con, name):
    got = plans.queries()[name](spark, data).toPandas()
    if name in plans.sql():
        assert canon(got) == canon(con.execute(plans.sql()[name]).df())
