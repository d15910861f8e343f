"""Every catalogue query against its SQL."""

import pytest

from sieveloom.plans import catalogue
from tests.oracle import DATA, check, have_data

pytestmark = pytest.mark.skipif(not have_data(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, name):
    check(catalogue.QUERIES[name](spark, DATA), catalogue.ORACLE_SQL[name])
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
