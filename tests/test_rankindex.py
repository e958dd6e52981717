"""Deep pages against a full sort, and the rows they read."""

import pytest
from pyspark.sql import functions as F
from test_textindex import read_rows

from marlstone.sources import rankindex


@pytest.fixture(scope="module")
def frame(spark):
    i = F.col("id")
    return spark.range(30_000).select(i, F.when(i % 97 > 0, F.pmod(F.xxhash64(i), F.lit(500))).alias("v"), F.concat(F.lit("t"), i % 11).alias("t")).repartition(5)


@pytest.fixture(scope="module")
def index(spark, frame, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rank")) + "/x"
    rankindex.build(frame, ["v", "t", "id"], path, 256)
    return rankindex.read(spark, path)


def test_pages(frame, index):
    rows = [r.id for r in frame.orderBy("v", "t", "id").select("id").collect()]
    back = [r.id for r in frame.orderBy(F.desc("v"), F.desc("t"), F.desc("id")).select("id").collect()]
    assert index.rows == 30_000 and index.pages() == 600 and len(index.counts) > 200
    for n in (1, 2, 7, 333, 599, 600, 601):
        assert [r.id for r in index.page(n).collect()] == rows[(n - 1) * 50 : n * 50]
        assert [r.id for r in index.page(n, descending=True).collect()] == back[(n - 1) * 50 : n * 50]
    assert [r.id for r in index.slice(29_990, 40).collect()] == rows[29_990:]
    assert [r.id for r in index.slice(100, 5000).collect()] == rows[100:5100]


def test_a_page_reads_its_ranges_only(index):
    for n in (1, 300, 600):
        assert read_rows(index.page(n)) < 0.02 * 30_000  # two of 256 ranges


def test_edges(spark, tmp_path):
    empty = rankindex.build(spark.createDataFrame([], "k int"), ["k"], str(tmp_path / "e"))
    assert empty.pages() == 0 and empty.page(1).count() == 0
    ties = rankindex.build(spark.createDataFrame([(1,)] * 7 + [(None,)], "k int"), ["k"], str(tmp_path / "t"), 8)
    assert [r.k for r in ties.page(1, 3).collect()] == [None, 1, 1] and ties.page(3, 3).count() == 2
