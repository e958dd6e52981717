"""Keyed state with expiry: known ids, freshness, counts by reason on timers, restarts."""

import time

from pyspark.sql import functions as F

from marlstone.streaming import ingest, known


def put(spark, path, rows, name):
    spark.createDataFrame(rows, "id string, v int").coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def run(spark, tmp, **options):
    stream = ingest.watch(spark, f"{tmp}/in/*", "id string, v int", files_at_once=1)
    q = known.ingest(stream, "id", f"{tmp}/out", f"{tmp}/state", buckets=4, refuse=F.when(F.col("v") < 0, "negative"), **options)
    done = q.awaitTermination(90)
    q.stop()
    assert done and q.exception() is None


def rows(spark, tmp):
    return sorted((r.id, r.v) for r in spark.read.parquet(f"{tmp}/out/rows").select("id", "v").collect())


def test_ids_expire_and_counts_come_on_timers(spark, tmp_path):
    p, options = str(tmp_path), dict(ttl_ms=25_000, report_ms=1)
    put(spark, f"{p}/in", [("a", 1), ("a", 2), ("b", 3), (None, 4), ("", 5), ("c", -1)], "1")
    run(spark, p, **options)
    assert rows(spark, p) == [("a", 1), ("b", 3)]
    put(spark, f"{p}/in", [("b", 6), ("d", 7)], "2")
    run(spark, p, **options)  # from the checkpoint: b is still known, and the counts of the first run are due
    assert rows(spark, p) == [("a", 1), ("b", 3), ("d", 7)]
    counts = {r.reason: r.n for r in known.audit(spark, f"{p}/out").collect()}
    assert counts.items() >= {"no_id": 2, "negative": 1}.items() and counts["new"] >= 2 and counts["known"] >= 1
    time.sleep(26)
    put(spark, f"{p}/in", [("a", 8)], "3")
    run(spark, p, **options)  # forgotten meanwhile
    assert rows(spark, p) == [("a", 1), ("a", 8), ("b", 3), ("d", 7)]


def test_stale_ids_come_again(spark, tmp_path):
    p, options = str(tmp_path), dict(ttl_ms=3_600_000, fresh_ms=1, report_ms=3_600_000)
    put(spark, f"{p}/in", [("a", 1)], "1")
    run(spark, p, **options)
    put(spark, f"{p}/in", [("a", 2)], "2")
    run(spark, p, **options)
    assert rows(spark, p) == [("a", 1), ("a", 2)]
    assert known.audit(spark, f"{p}/out").count() == 0  # no report was due
