"""The oracle statements of this subpackage against their queries."""

from __future__ import annotations

import pytest

from tests.compare import connect, difference
from vintara.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_statement(spark, folder, name):
    assert difference(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLES[name]) is None
