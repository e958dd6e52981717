"""Segmented scans against plain windows, and how rows spread."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import relational as R
from marlstone.operators import scan, stats
from marlstone.operators import timeseries as TS


@pytest.fixture(scope="module")
def series(spark):
    """A hot key, small keys, a null key, null times and null returns; times don't tie."""
    rng = random.Random(5)
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=d) if d else None, rng.uniform(-0.05, 0.06) if rng.random() > 0.1 else None, rng.uniform(1, 9)) for k, n in (("a", 400), ("b", 3), (None, 40), ("c", 1), ("d", 60)) for d in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t date, r double, p double").cache()


def same(a, b, *columns):
    order = lambda df: sorted(((str(r.k), str(r.t), *(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns)) for r in df.collect()), key=str)
    assert order(a) == order(b)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_windows_equal_plain_ones(series, parts):
    for f, columns in (
        (lambda **p: TS.simple_return(series, ["k"], "t", "p", **p), ["ret"]),
        (lambda **p: TS.momentum(series, ["k"], "t", "p", 25, **p), ["mom"]),
        (lambda **p: TS.rolling(series, ["k"], "t", "p", 30, **p), ["mean_30", "std_30"]),
        (lambda **p: TS.next_period(series, ["k"], "t", "p", **p), ["target"]),
        (lambda **p: TS.drawdown(TS.wealth(series, ["k"], "t", "r", **p), ["k"], "t", "r", **p), ["wealth", "drawdown"]),
        (lambda **p: TS.drawdown(series, ["k"], "t", "r", include_initial=False, **p), ["drawdown"]),
        (lambda **p: TS.midpoint(series.filter("k is not null"), ["k"], "t", **p), ["half"]),
        (lambda **p: TS.numbered(series, ["k"], "t", "i", **p), ["i"]),
    ):
        same(f(parts=parts), f(), *columns)


def test_one_series_without_a_key(series):
    one = series.filter("k = 'a' and t is not null")
    w = Window.partitionBy(F.lit(1)).orderBy("t")
    same(TS.rolling(one, [], "t", "p", 20), one.withColumns({"mean_20": F.when(F.count("p").over(w.rowsBetween(-19, 0)) == 20, F.avg("p").over(w.rowsBetween(-19, 0)))}).withColumn("std_20", F.when(F.col("mean_20").isNotNull(), F.stddev_pop("p").over(w.rowsBetween(-19, 0)))), "mean_20", "std_20")
    a, b = (stats.newey_west(one.filter("r is not null"), k, "t", "r").first() for k in ([], ["k"]))
    assert abs(a.t_nw - b.t_nw) < 1e-9 and a.n == b.n
    same(TS.blocks(one, [], "t", "p", 7).withColumnsRenamed({"block": "t"}).withColumn("k", F.lit(1)), TS.blocks(one, ["k"], "t", "p", 7).withColumnsRenamed({"block": "t"}).withColumn("k", F.lit(1)), "realized")


def test_one_key_spreads_over_200_parts(spark):
    parts, n = 200, 100_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("r"))
    s = scan.segments(df, ["k"], "t", parts)
    dealt = s.dealt().groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) > parts * 0.9 and max(r["count"] for r in dealt) < 2 * n / parts
    out = TS.numbered(df, ["k"], "t", "i", parts=parts)
    assert out.filter("i <> t + 1").isEmpty()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "hashpartitioning(k" not in plan  # no shuffle by the key alone


def test_short_segments_take_from_several(spark):
    df = spark.range(40).select(F.lit("x").alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("p"))
    got = TS.log_return(df.filter("t > 0"), [], "t", "p", 15, parts=30).filter("log_ret is not null")
    assert got.count() == 24 and got.filter("abs(log_ret - (ln(p) - ln(p - 15))) > 1e-9").isEmpty()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, t date, r double, p double")
    for f in (TS.simple_return(empty, [], "t", "p"), TS.drawdown(empty, [], "t", "r"), TS.midpoint(empty, [], "t"), TS.next_period(empty, [], "t", "p")):
        assert f.count() == 0
    assert R.as_of_join(empty, empty.select("k", F.col("t").alias("u"), F.col("p").alias("q")), ["k"], "t", "u", ["q"]).count() == 0


def test_as_of_join_of_a_hot_key(spark):
    left = spark.range(30_000).select((F.col("id") % 50 == 0).cast("int").alias("k"), F.col("id").alias("t"))
    right = spark.range(0, 30_000, 97).select(F.lit(0).alias("k"), F.col("id").alias("u"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    out = R.as_of_join(left, right, ["k"], "t", "u", ["v"], parts=64)
    want = F.when((F.col("k") == 0) & (F.floor(F.col("t") / 97) * 97 % 2 == 0), F.floor(F.col("t") / 97) * 97)
    assert out.count() == 30_000 and out.filter(~F.col("v").eqNullSafe(want)).isEmpty()
