import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import compare, connect  # noqa: E402

from harmonia import queries  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, name):
    compare(spark, con, SF, queries.Q[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.Q) - set(queries.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.Q[name](spark, SF).count() > 0
