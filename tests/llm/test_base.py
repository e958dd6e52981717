"""Written tables, and the helpers on names and bits."""

import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.llm import base
from marlstone.llm import textbytes as tb


def test_stash_and_release(spark):
    base.release(spark)
    back = base.stash(spark.range(5))
    assert back.count() == 5 and f"{base.shared_dir(spark)}/marlstone-" in back.inputFiles()[0]
    other = base.stash(spark.range(7))
    assert base.release(spark, keep=other) == 1 and other.count() == 7
    assert base.release(spark) == 1 and base.release(spark) == 0


def test_fresh_names(spark):
    assert base.fresh(spark.createDataFrame([(1, 2)], "score int, _Score int"), "score", "score", "x") == ["__score", "___score", "x"]


def test_bits(spark):
    ids = [0, 1, 7, 8, 32_767, 32_768, 32_769, 100_000, -5]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    maps = df.groupBy(F.bitmap_bucket_number("id").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("m"))
    probe = spark.createDataFrame([(i,) for i in [*ids, 2, 9, 99_999]], "id long")
    got = probe.join(maps, F.bitmap_bucket_number("id") == F.col("b"), "left").select("id", base.bit(F.col("m"), F.bitmap_bit_position("id")).alias("has")).collect()
    assert {r.id for r in got if r.has} == set(ids)


def test_lower_only_ascii(spark):
    r = spark.createDataFrame([("AbÉ",), ("ABZ[",), ("",)], "t string").select(base.ascii_lower(F.col("t")).alias("t")).collect()
    assert [x.t for x in r] == ["abÉ", "abz[", ""]


def test_first_of_each(spark):
    df = spark.createDataFrame([(i, i % 10 // 9) for i in range(3000)], "id long, k int")
    whole = base.first_of_each(df, "k", "id", 40, slots=1).collect()
    assert sorted(base.first_of_each(df, "k", "id", 40).collect()) == sorted(whole) and len(whole) == 80
    order = df.orderBy(F.xxhash64("id")).collect()
    assert sorted(whole) == sorted(r for k in (0, 1) for r in [x for x in order if x.k == k][:40])
    assert base.first_of_each(df, "k", "id", 10_000).count() == 3000 and base.first_of_each(df.limit(0), "k", "id", 3).count() == 0


def test_words_of_one_polynomial():
    """Words of 1,024 and more letters that follow the Thue-Morse sequence and its complement have hashes of their own, in both kinds of words."""
    for n in (1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        a, b = ("".join("ab"[x ^ k] for x in bits) for k in (0, 1))
        for kind in (tb.ALNUM, tb.SPACED):
            h = tb.tokenize(*tb.buffers(pa.array([f"{a} {b} {a}"])), kind).hash
            assert h[0] == h[2] != h[1]
