"""Bucketed digests: differences of tables by reading again only what differs."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import relational as R


def shuffled_rows(df):
    """Rows that all exchanges of a run wrote."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes, n = [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan], 0
    while nodes:
        x = nodes.pop()
        if "QueryStage" in x.nodeName():
            nodes.append(x.plan())
        if x.nodeName() == "Exchange":
            n += x.metrics().apply("shuffleRecordsWritten").value()
        kids = x.children()
        nodes += [kids.apply(i) for i in range(kids.size())]
    return n


def test_equal_tables_shuffle_no_rows(spark):
    a = spark.range(300_000).select("id", (F.col("id") * 7 % 101).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    b = a.repartition(5, "v")
    assert R.unchanged(a, b)
    assert shuffled_rows(R.changed_buckets(a, a.select("*"), ["id"], a.columns, 64)) <= 64 * 2 * 4
    assert R.snapshot_diff(a, b, "id", ["v", "s"]).isEmpty()


def test_one_row_in_a_million(spark):
    a = spark.range(1_000_000).select("id", (F.col("id") % 7).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 777_777, 9).otherwise(F.col("v")))
    assert not R.unchanged(a, b)
    out = R.snapshot_diff(a, b, "id", ["v"])
    assert [tuple(r) for r in out.collect()] == [(777_777, "modified", "v", str(777_777 % 7), "9")]
    assert shuffled_rows(out) < 4 * R.DIGEST_BUCKETS * 2 + 1000


def test_repeats_nulls_and_moved_values(spark):
    schema = "a int, b int, c string"
    rows = [(1, None, "x"), (1, None, "x"), (None, 1, "x"), (2, 2, None)]
    df = lambda r: spark.createDataFrame(r, schema)
    same = lambda x, y: R.unchanged(df(x), df(y), 8)
    assert same(rows, rows[::-1]) and same([], [])
    assert not same(rows, rows[1:]) and not same(rows, rows + rows[:1]) and not same([(1, None, "x")], [(None, 1, "x")]) and not same([(2, 2, None)], [(2, 2, "")])
    got = sorted(tuple(r) for r in R.row_changes(df(rows), df(rows[2:] + [(3, 3, "y")] * 2)).collect())
    assert got == [(1, None, "x", 2, "old"), (3, 3, "y", 2, "new")]
    with pytest.raises(ValueError):
        R.unchanged(df(rows), df(rows).withColumn("c", F.lit(1)))


def test_diff_equals_a_full_join(spark):
    old = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 5).alias("x"), F.when(F.col("id") % 4 > 0, F.lit("t")).alias("y"))
    new = spark.range(40, 560).select(F.col("id").alias("k"), (F.col("id") % 5 + (F.col("id") % 50 == 0).cast("int")).alias("x"), F.when(F.col("id") % 4 > 0, F.lit("t")).when(F.col("id") % 100 == 0, F.lit("")).alias("y"))
    few, many = (sorted(map(str, R.snapshot_diff(old, new, "k", ["x", "y"], n).collect())) for n in (1, 4096))
    assert few == many and len(few) > 100
