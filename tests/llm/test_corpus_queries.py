"""Every query of the corpus problems runs at the smallest scale, and agrees with its SQL."""

import pytest
from compare import check

from paperloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE.get(name))
