"""Range joins by dyadic nodes against every pair."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import relational as R
from marlstone.plans import catalog, queries  # noqa: F401


def pairs(points, ranges):
    return sorted((p, r) for p, x in points for r, a, b in ranges if None not in (x, a, b) and a <= x < b)


def joined(spark, points, ranges, kind):
    p = spark.createDataFrame(points, f"p int, x {kind}").repartition(3)
    r = spark.createDataFrame(ranges, f"r int, a {kind}, b {kind}")
    return sorted((x.p, x.r) for x in R.range_join(p, r, "x", "a", "b").collect())


def test_all_widths(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(0, 1e9)) for i in range(400)] + [(900, None), (901, 0.0), (902, 1e9), (903, -5.0), (904, 2e9)]
    ranges = [(k, x, x + 2.0 ** rng.uniform(-3, 30)) for k in range(300) for x in [rng.choice(points)[1] or 0.0]] + [(301, 5.0, 5.0), (302, 9.0, 1.0), (303, None, 1.0), (304, float("-inf"), 3e8), (305, 7e8, float("inf")), (306, float("-inf"), float("inf"))]
    assert joined(spark, points, ranges, "double") == pairs(points, ranges)


def test_whole_numbers_touching_ranges_and_repeats(spark):
    points = [(i, i % 50) for i in range(120)]
    ranges = [(k, k, k + 1) for k in range(50)] + [(60 + k, 0, 50) for k in range(3)] + [(70, 10, 11)]
    assert joined(spark, points, ranges, "long") == pairs(points, ranges)
    assert joined(spark, points, [(1, 3, 4)], "int") == pairs(points, [(1, 3, 4)])
    assert joined(spark, points, [(1, 5, 5)], "int") == [] == joined(spark, [], ranges, "int") == joined(spark, points, [], "int")


def test_dates_and_times(spark):
    rng = random.Random(3)
    day = lambda: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=rng.randrange(3 * 10**9))
    points = [(i, day()) for i in range(200)]
    ranges = [(k, x, x + dt.timedelta(seconds=2 ** rng.randrange(32))) for k in range(150) for x in [rng.choice(points)[1]]]
    for kind in ("timestamp", "timestamp_ntz"):
        assert joined(spark, points, ranges, kind) == pairs(points, ranges)
    dates = [(i, x.date()) for i, x in points]
    assert joined(spark, dates, [(k, a.date(), b.date()) for k, a, b in ranges], "date") == pairs(dates, [(k, a.date(), b.date()) for k, a, b in ranges])
    mixed = R.range_join(spark.createDataFrame(points, "p int, x timestamp_ntz"), spark.createDataFrame([(k, a.date(), b.date()) for k, a, b in ranges], "r int, a date, b date"), "x", "a", "b")
    floor = lambda d: dt.datetime.combine(d, dt.time())
    assert sorted((r.p, r.r) for r in mixed.collect()) == pairs(points, [(k, floor(a.date()), floor(b.date())) for k, a, b in ranges])


def test_plan_has_no_nested_loop(spark):
    points = spark.range(10_000).select(F.col("id").alias("x"))
    ranges = spark.range(3000).select(F.col("id").alias("r"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + 2 + (F.col("id") % 5000 == 0).cast("int") * 9000).alias("b"))
    out = R.range_join(points, ranges, "x", "a", "b")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.count() == points.join(ranges, (F.col("x") >= F.col("a")) & (F.col("x") < F.col("b"))).count()


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(50).withColumn("t", F.repeat(F.lit("x"), 1000))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(R.small(wide)) and not hinted(R.small(wide, size=10_000)) and not hinted(R.small(wide, rows=10))


def test_bounds_are_worked_out_once(spark):
    """The tree's nodes are made from stored columns: as expressions the bounds were worked out anew for each level and node, 2 ms a range."""
    points = spark.range(50).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("x"))
    ranges = spark.range(50).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("a"), F.timestamp_seconds(F.col("id") + 9).cast("timestamp_ntz").alias("b"))
    plan = R.range_join(points, ranges, "x", "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("hour(") <= 6


def sums(points, ranges):
    found = {}
    for k, a, b in ranges:
        if None not in (k, a, b):
            held = [v for x, v in points if x is not None and a <= x < b]
            s, n = found.get(k, (0, 0))
            found[k] = (s + sum(v or 0 for v in held), n + len(held)) if a < b else (s, n)
    return {k: v for k, v in found.items() if v[1]}


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_sums_of_ranges_are_those_of_their_pairs(spark, parts):
    rng = random.Random(4)
    points = [(rng.randrange(300), rng.choice([None, *range(-5, 9)])) for _ in range(900)] + [(None, 3), (-50, 1), (400, 1)]
    ranges = [(rng.randrange(60), a, a + rng.choice([-3, 0, 1, 2, 7, 60, 300])) for _ in range(150) for a in [rng.randrange(-20, 320)]] + [(90, None, 9), (91, 9, None), (92, 5, 5), (93, 500, 600), (None, 5, 9)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        p, r = spark.createDataFrame(points, "x long, v int"), spark.createDataFrame(ranges, "k int, a long, b long")
        out = R.range_sums(p, r, "x", "a", "b", ["k"], s=F.col("v"), n=F.lit(1)).filter("n > 0 and k is not null")
        assert {x.k: (x.s, x.n) for x in out.collect()} == sums(points, ranges)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter", "")  # but for the segments' carries
        assert R.range_sums(p.limit(0), r, "x", "a", "b", ["k"], n=F.lit(1)).filter("n <> 0").isEmpty() and R.range_sums(p, r.limit(0), "x", "a", "b", ["k"], n=F.lit(1)).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_sums_of_times(spark):
    points = [(dt.datetime(2000, 1, d), d) for d in range(1, 29)]
    ranges = [(k, dt.date(2000, 1, k), dt.date(2000, 1, k) + dt.timedelta(days=9)) for k in range(1, 20)]
    out = R.range_sums(spark.createDataFrame(points, "x timestamp_ntz, v int"), spark.createDataFrame(ranges, "k int, a date, b date"), "x", "a", "b", ["k"], s=F.col("v"))
    assert {r.k: r.s for r in out.collect()} == {k: sum(range(k, min(29, k + 9))) for k in range(1, 20)}


def test_shipments_in_ranges_make_no_pairs(spark):
    """Ranges met each date that they hold, one by one."""
    df = catalog.QUERIES["shipments_in_ranges"](spark, "/root/testdata/sf0.001")
    df.collect()
    assert "Join Inner" not in df._jdf.queryExecution().optimizedPlan().toString()
