import pytest

from palimpsest.plans import catalog
from tests.conftest import DATA
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, name):
    check(catalog.QUERIES[name](spark, DATA), catalog.ORACLE_SQL[name], DATA)
