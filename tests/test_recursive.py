"""Walks to any depth."""

import json

import pytest

from marlstone.operators import quality
from marlstone.operators import relational as R


def test_json_at_any_depth(spark):
    deep = {"secret": "https://end"}
    for i in range(60):
        deep = {f"k{i}": [deep, i]}
    rows = [(1, json.dumps(deep)), (2, json.dumps({"a": "secret", "b": ["http://x", {"token": 1}, "http://x"]})), (3, "no json"), (4, None), (5, "[]"), (6, '"http://top"')]
    df = spark.createDataFrame(rows, "id int, j string")
    assert sorted((r.key, r.detail) for r in quality.forbidden_keys(df, "id", "j", ["secret", "token"]).collect()) == [("1", "secret"), ("2", "token")]
    assert sorted(tuple(r) for r in quality.json_urls(df, "id", "j").collect()) == [(1, "https://end"), (2, "http://x")]


def test_too_deep_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_LEVELS", 5)
    df = spark.createDataFrame([(1, "[[[[[[[[1]]]]]]]]")], "id int, j string")
    with pytest.raises(Exception, match="(?i)recursion"):
        quality.json_nodes(df, "id", "j").collect()


def test_descendants(spark):
    links = spark.createDataFrame([("t", "a"), ("t", "b"), ("a", "c"), ("b", "c"), ("c", "d"), (None, "x"), ("t", "a")], "p string, c string")
    got = sorted(tuple(r) for r in R.descendants(links, "p", "c").collect() if r.root == "t")
    assert got == [("t", "a", 1), ("t", "b", 1), ("t", "c", 2), ("t", "d", 3)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "p int, c int")
    assert R.descendants(chain, "p", "c").count() == 30 * 31 // 2
    for bad in ([("a", "b"), ("b", "a")], [("a", "a")]):
        with pytest.raises(Exception, match="cycle"):
            R.descendants(spark.createDataFrame(bad, "p string, c string"), "p", "c").collect()
