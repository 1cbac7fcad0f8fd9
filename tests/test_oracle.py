"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bindings import ORACLE, QUERIES  # noqa: E402
from tools.check_oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(
    not os.path.isdir(SF) or os.environ.get("HEARTHLINE_FAST") == "1", reason="no tables, or a fast run"
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, problem = compare(spark, con, SF, QUERIES[name], ORACLE.get(name))
    assert problem is None
