import pytest

from ledgerlens.llm.catalog import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name]) > 0
