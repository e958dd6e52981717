"""Queries that have a SQL twin equal it on whole tables."""

import oracle
import pytest

from marlstone.llm import catalog

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, name):
    assert oracle.differs(catalog.QUERIES[name](spark, SF), oracle.connect(SF), catalog.ORACLES[name]) is None
