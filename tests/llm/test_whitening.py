"""Whitening against numpy's own decomposition and exact whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, k=8):
    """x, exact deviations, projections up to sign, eigenvalues over the trace."""
    x = [[math.floor(1024 * float(np.float64(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    m = np.array(x, float) - np.array(s) / n
    e, q = np.linalg.eigh(m.T @ m / n)
    e, q = e[::-1], q[:, ::-1]
    return deviation, m @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(found, ids, vectors, k=8):
    deviation, w, explained = plain(vectors, k)
    rows = {(r.vec_id, r.component): r for r in found.collect()}
    assert len(rows) == len(ids) * k
    sign = [1 if rows[ids[0], j + 1].whitened * w[0][j] > 0 else -1 for j in range(k)]
    for i, v in enumerate(ids):
        for j in range(k):
            r = rows[v, j + 1]
            assert r.n == len(ids) and int(r.deviation) == deviation[i]
            assert abs(r.whitened - sign[j] * w[i][j]) < 1e-8
            assert abs(r.explained / explained[j] - 1) < 1e-9 and r.identity_error < 1e-9


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    found = whitening.op13_whitening(spark, SF)
    assert dict(found.dtypes)["deviation"] == "bigint" and dict(found.dtypes)["component"] == "int"
    compare(found, [r.vec_id for r in rows], [r.embedding for r in rows])


def test_nulls_repeats_and_other_columns(spark):
    rng = np.random.default_rng(7)
    good = [rng.normal(size=3).astype("float32").tolist() for _ in range(40)] + [[0.5, -0.25, 1.0]] * 5
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, float("inf"), 0.0], [1.0, 0.0, float("-inf")]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good + bad)], SCHEMA).withColumns({"x": F.lit(1), "id": F.lit("a"), "deviation": F.lit(None), "v": F.lit(2)}).repartition(5)
    compare(whitening.whiten(df), list(range(45)), good, 3)


def test_large_deviations_are_exact(spark):
    vectors = [[3e6 * i, 1e5 * (i % 7), -2e6 * i * i] for i in range(60)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    want, _, _ = plain(vectors, 2)
    assert max(want) > 1 << 63
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(df).filter("component = 1").collect()} == dict(enumerate(want))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).count() == 0
    assert set(whitening.whiten(empty).columns) == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 4, SCHEMA)).count() == 0  # nothing varies
    line = whitening.whiten(spark.createDataFrame([(None, [float(i), 2.0 * i]) for i in range(6)], SCHEMA))
    assert {(r.vec_id, r.component, round(r.explained, 9)) for r in line.collect()} == {(None, 1, 1.0)}  # one direction
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [1.0])], SCHEMA))
