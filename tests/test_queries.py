"""Every registered query of the library runs, and equals its SQL twin."""

import oracle
import pytest

from marlstone.plans import audits, catalog, landing, queries, research  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert oracle.differs(df, con, catalog.ORACLES[name]) is None
        assert con.execute(f"select count(*) from ({catalog.ORACLES[name]})").fetchall()[0][0] > 0  # nothing on both sides proves nothing
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
