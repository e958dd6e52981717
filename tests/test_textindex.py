"""The trigram index: results of plain filters, and rows read."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.operators import relational as R
from marlstone.sources import readers, textindex


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Rows in order; one block alone holds 'needle', blocks of even hundreds hold 'ÄHRE'."""
    i = F.col("id")
    df = spark.range(20_000).select(i, F.concat(F.lit("row number "), i.cast("string"), F.when(i == 712, " a Needle, here").otherwise(""), F.when(i % 4000 == 9, " goldene ÄHRE").otherwise("")).alias("t"), F.when(i % 3 > 0, F.lit("k_%s")).alias("u"))
    return textindex.build(df.repartitionByRange(4, "id"), ["t", "u"], str(tmp_path_factory.mktemp("index")), block_rows=100, row_group=1 << 12)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def read_rows(df):
    """Rows that the scan of df gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes, n = [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan], 0
    while nodes:
        x = nodes.pop()
        if "Scan parquet" in x.nodeName():
            n += x.metrics().apply("numOutputRows").value()
        kids = x.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
    return n


def test_results(index):
    whole = index.table
    for q in ("Needle", "needle", "ÄHRE", "ähre", "number 19", "9", "no such", "ro", "_%s"):
        assert ids(index.search(q, ["t"])) == ids(whole.filter(F.col("t").contains(q))), q
        assert ids(index.search(q, folded=["t", "u"])) == ids(R.text_search(whole, q, [], ["t", "u"])), q
    for p in ("%NEEDLE%", "row%712%", "%a_b%", "%", "row number 7__2", "%k\\_\\%s", "%here"):
        for c in ("t", "u"):
            assert ids(index.ilike(c, p)) == ids(whole.filter(F.col(c).ilike(p))), p
    assert index.search("", ["t"]).count() == 20_000 and textindex.BLOCK not in index.search("x", ["t"]).columns
    with pytest.raises(ValueError):
        index.search("abc", ["id"])


def test_only_candidate_blocks_are_read(spark, index):
    assert 200 <= index.table.select(textindex.BLOCK).distinct().count() <= 204
    assert [r[0] for r in index.candidates([("t", "needle")]).collect()] == [index.table.filter("id = 712").first()[textindex.BLOCK]]
    assert read_rows(index.search("Needle", ["t"])) < 2000
    assert read_rows(index.search("ro", ["t"])) == 20_000
    assert index.candidates([("t", "ro")]) is None


def test_many_candidates_are_joined(index, monkeypatch):
    monkeypatch.setattr(textindex, "CONSTANTS", 3)
    assert ids(index.search("ÄHRE", ["t"])) == [9, 4009, 8009, 12009, 16009]


def test_pages_over_an_index(spark, index, tmp_path):
    assert [r.id for r in R.search_page(index, "goldene", ["t"], [], [F.col("id").desc()], 2).collect()] == [16009, 12009]
    pages = spark.createDataFrame([("API/one", '{"data": [{"k": "1"}]}', 1), ("other", "{}", 2), (None, "{}", 3)], "key string, value string, created_at int")
    cache = textindex.build(pages, ["key"], str(tmp_path / "x"))
    assert [r.record for r in readers.cache_pages(cache, "%api/%").collect()] == [{"k": "1"}]


def test_edges(spark, tmp_path):
    empty = textindex.build(spark.createDataFrame([], "id long, t string"), ["t"], str(tmp_path / "e"))
    assert empty.table.count() == 0
    long = "x" * 50_000 + "end"
    one = textindex.build(spark.createDataFrame([(1, long), (2, None), (3, ""), (3, "")], "id long, t string"), ["t"], str(tmp_path / "o"))
    assert ids(one.search("xend", ["t"])) == [1] and one.search("", ["t"]).count() == 4


@given(st.text(alphabet="ab%_", max_size=8))
def test_like_parts(pattern):
    assert textindex.like_parts(pattern) == re.findall("[ab]+", pattern)
    assert textindex.like_parts(re.sub("([%_])", r"\\\1", pattern)) == ([pattern] if pattern else [])


def test_grams_that_depend_on_what_follows():
    assert textindex.grams("ΟΔΟΣ") == ["οδο"] and textindex.grams("ab") == []
