"""Queries on keys and texts that the small tables don't have, against their SQL twins."""

import os

import oracle
import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.plans import audits, catalog, landing, queries  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def differs(spark, tmp_path):
    """What a query gives otherwise than its SQL, where one table's rows are those of a SELECT from the small one."""

    def of(name, table, select):
        for t in oracle.TABLES:
            if t != table:
                os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
        oracle.connect(SMALL).execute(f"copy ({select}) to '{tmp_path}/{table}.parquet' (format parquet)")
        con = oracle.connect(tmp_path)
        assert con.execute(f"select count(*) from {table}").fetchall()[0][0] > 0
        return oracle.differs(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])

    return of


def test_sizes_of_large_ids(differs):
    assert differs("scalar_values", "events", "select * replace (event_id + d as event_id) from (select * from events limit 20), (values (0), (1010), (1024000), (1048570), (2000000000), (5000000000000)) t(d)") is None


def test_sizes_have_no_separators(spark):
    sizes = [1023, 1024, 1280, 1023 * 1024, 1024**2, 1023 * 1024**2, 1024**3, 5 * 1024**4]
    got = spark.createDataFrame([(x,) for x in sizes], "c long").select(S.byte_size(F.col("c")).alias("all"), S.byte_size(F.col("c"), largest="MB").alias("mb"), S.byte_size(F.col("c"), largest="KB").alias("kb")).collect()
    assert [r.all for r in got] == ["1023 B", "1.0 KB", "1.2 KB", "1023.0 KB", "1.0 MB", "1023.0 MB", "1.0 GB", "5120.0 GB"]
    assert [r.mb for r in got][4:] == ["1.0 MB", "1023.0 MB", "1024.0 MB", "5242880.0 MB"]
    assert [r.kb for r in got][3:6] == ["1023.0 KB", "1024.0 KB", "1047552.0 KB"]


def test_codes_of_large_keys(differs):
    assert differs("scalar_codes", "part", "select * replace (p_partkey + d as p_partkey) from (select * from part limit 20), (values (0), (89985), (100000), (989990), (12345680)) t(d)") is None


def test_terms_beside_letters_of_other_scripts(differs):
    """For the SQL's \\b such a letter ends a word, unless it is lower-cased to one of a-z."""
    texts = ["the é", "éthe", "theß", "und中 the_", "İthe K", "theK und", "ünd undü", "THÉ und9", "the und", "9the", "x-und-y ẗhe", ""]
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    assert differs("term_selection", "documents", f"select i::bigint doc_id, t \"text\", 'en' lang, 's' source, length(t) n_chars from (values {rows}, (99, null)) v(i, t)") is None


def test_terms_by_ascii_words_or_any(spark):
    df = spark.createDataFrame([("théo the_ the-é",), ("élan theé",), ("Straßenthe",)], "t string")
    found = lambda **k: [list(r.m) for r in df.select(S.matched_terms(F.col("t"), ["the", "lan"], **k).alias("m")).collect()]
    assert found() == [["the"], [], []] and found(ascii=True) == [["the"], ["lan", "the"], []]


def test_window_of_bars_of_any_year(differs):
    assert differs("window_fetch", "part", "select * replace (p_partkey + d as p_partkey) from (select * from part limit 20), (values (0), (29200), (1200000), (3000000)) t(d)") is None
