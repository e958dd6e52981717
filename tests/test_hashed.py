"""Hash-dealt tables: what an upsert reads, writes and keeps."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import relational as R
from marlstone.sources import hashed

SCHEMA = "k int, v string, o int"


def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, path, version=None):
    return sorted((tuple(r) for r in hashed.read(spark, path, version).select("k", "v").collect()), key=str)


def test_upserts(spark, tmp_path):
    p = str(tmp_path / "t")
    assert hashed.upsert(spark, p, df(spark, [(1, "a", 0), (2, "b", 0), (None, "n", 0)]), ["k"], parts=4) == 1
    assert hashed.upsert(spark, p, df(spark, [(2, "c", 2), (2, "x", 1), (3, "d", 0), (None, "m", 0)]), ["k"], "o") == 2
    assert table(spark, p) == sorted([(1, "a"), (2, "c"), (3, "d"), (None, "m")], key=str)
    assert table(spark, p, 1) == sorted([(1, "a"), (2, "b"), (None, "n")], key=str)  # readers of the first version keep it
    assert hashed.upsert(spark, p, df(spark, [(3, "d", 0)]), ["k"]) == 2 == hashed.upsert(spark, p, df(spark, []), ["k"])
    assert hashed.vacuum(spark, p) > 0 and table(spark, p)[0] == (1, "a")
    for bad in (df(spark, [(1, "a", 0)]).drop("o"), df(spark, [(1, "a", 0)]).withColumn("o", F.lit("x"))):
        with pytest.raises(ValueError):
            hashed.upsert(spark, p, bad, ["k"])
    with pytest.raises(ValueError):
        hashed.read(spark, str(tmp_path / "none"))


def test_only_changed_folders_are_written(spark, tmp_path):
    p, n = str(tmp_path / "t"), 20_000
    rows = spark.range(n).select(F.col("id").cast("int").alias("k"), F.col("id").cast("string").alias("v"), F.lit(0).alias("o"))
    hashed.upsert(spark, p, rows, ["k"], parts=64)
    folder = lambda d: d.withColumn("p", F.pmod(F.xxhash64("k", F.col("k").isNull()), F.lit(64)))
    some = folder(rows).filter("p < 5 and k % 20 = 0").drop("p").withColumn("v", F.when(F.col("k") % 40 == 0, "new").otherwise(F.col("v")))
    assert hashed.upsert(spark, p, some, ["k"]) == 2
    at = hashed.pointer(spark, p)["versions"]
    assert sorted(int(k) for k, v in at.items() if v == 2) == [0, 1, 2, 3, 4] and len(at) == 64
    assert spark.read.parquet(f"{p}/v=2").count() < n * 5 / 64 * 1.3
    assert hashed.read(spark, p).filter("v = 'new'").count() == some.filter("v = 'new'").count() and hashed.read(spark, p).count() == n
    assert hashed.upsert(spark, p, some, ["k"]) == 2  # again: nothing changes


def test_a_failed_version_is_not_seen(spark, tmp_path):
    p = str(tmp_path / "t")
    hashed.upsert(spark, p, df(spark, [(1, "a", 0)]), ["k"], parts=2)
    df(spark, [(9, "half", 0)]).withColumn("__part", F.lit(0)).write.partitionBy("__part").parquet(f"{p}/v=2")  # written, but no pointer
    assert table(spark, p) == [(1, "a")]
    assert hashed.upsert(spark, p, df(spark, [(2, "b", 0)]), ["k"]) == 2 and table(spark, p) == [(1, "a"), (2, "b")]


def test_last_of_repeated_keys_wins(spark):
    old, new = df(spark, [(1, "a", 0), (2, "b", 0)]), df(spark, [(2, "x", 5), (2, "y", 4), (2, "z", 4)])
    assert sorted(tuple(r) for r in R.upsert(old, new.coalesce(1), ["k"]).collect()) == [(1, "a", 0), (2, "z", 4)]
    assert sorted(tuple(r) for r in R.upsert(old, new, ["k"], "o").collect()) == [(1, "a", 0), (2, "x", 5)]
