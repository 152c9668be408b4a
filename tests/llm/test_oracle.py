import pytest

import __spark_entry__ as entry
from revlens.llm.queries import ORACLE
from tests.conftest import SF_SMALL
from tools.oracle_check import compare


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_its_sql(spark, key):
    assert compare(spark, SF_SMALL, {key}, verbose=False)[key]["status"] == "match"
    assert entry.oracle_sql()[key] == ORACLE[key]
