"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Bits of the filter for each row, and of one part of it: with more rows, the rows are dealt into parts by their hash, each with a filter of its own, so that no broadcast exceeds PART_BITS / 8 bytes.
BITS_A_ROW, PART_BITS = 16, 1 << 28


def _digest(text):
    return F.unhex(F.sha2(base.ascii_lower(F.coalesce(text, F.lit(""))), 256))


def _place(seed: int, bits: int):
    return F.pmod(F.xxhash64(F.col("sha"), F.lit(seed)), F.lit(bits)) + 1


def repeated_filter(keys: DataFrame, seed: int, bits: int) -> DataFrame:
    """(bucket, bitmap) of the positions that at least two rows hit. What shuffles is a position and a count for each row, combined in the map tasks."""
    often = keys.select(_place(seed, bits).alias("p")).groupBy("p").agg(F.count("*").alias("n")).filter("n > 1")
    return base.bitmaps(often.select("p"))


def _split(keys: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """Rows that are alone, in two tables, and those that may be repeated: rows whose first position another row hits go on to the second, which is counted among them only."""
    alone = []
    for seed in (1, 2):
        filter_ = base.stash(repeated_filter(keys, seed, bits))
        probed = base.stash(base.probe(keys, _place(seed, bits), filter_, "maybe"))
        alone.append(probed.filter("not maybe").drop("maybe"))
        keys = probed.filter("maybe").drop("maybe")
    return alone, keys


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest id stays (a null id is smallest); of rows that tie on id too, one stays.
    Pass one counts positions of a filter of BITS_A_ROW bits a row (or `bits`) and keeps those hit twice; pass two probes all rows.
    Rows with a clear bit are unique and pass straight through; of unique rows about one in 200 goes on. Only what goes on shuffles, as digests; the
    sizes of its groups, combined in the map tasks, are joined to it by a broadcast or a join whose large partitions AQE can split, so that a hot group
    needs no task of its own. The filter grows with the rows, in parts of PART_BITS. Very long texts are read whole.
    An empty table gives an empty result. Columns other than id and text are not read.
    """
    keys = base.stash(docs.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("row")))
    bits = bits or max(1 << 16, keys.count() * BITS_A_ROW)
    parts = -(-bits // PART_BITS)
    if parts > 1:
        keys = base.stash(keys.withColumn("part", F.pmod(F.xxhash64("sha", F.lit(0)), F.lit(parts)).cast("int")), by="part")
    alone, maybe = [], []
    for part in range(parts):
        one, several = _split(keys.filter(F.col("part") == part).drop("part") if parts > 1 else keys, -(-bits // parts))
        alone += one
        maybe.append(several)
    alone, maybe = (reduce(DataFrame.unionByName, x) for x in (alone, maybe))
    groups = base.stash(maybe.groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("k")).filter("n > 1"))
    shuffled = maybe.join(base.bounded(groups, 128), "sha", "left").select("id", "sha", "row", "n", "k")
    rows = alone.select("id", "sha", "row", F.lit(None).cast("long").alias("n"), F.lit(None).cast(groups.schema["k"].dataType).alias("k")).unionByName(shuffled)
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("k.id"))
    return rows.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("row") == F.col("k.row"), F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay.

    A row is found again by (id, digest). Rows that tie on both are reduced to one.
    """
    found = base.stash(exact_dedup(docs, id_col, text_col))
    k_id, k_sha = base.fresh(docs, "drop_id", "drop_sha")
    gone = found.groupBy(F.col(id_col).alias(k_id), F.unhex("text_sha256").alias(k_sha)).agg(F.max("kept").alias("any"), F.count("*").alias("n"))
    gone = base.stash(gone.filter("not any or n > 1"))
    same = lambda side: (F.col(id_col).eqNullSafe(side[k_id])) & (_digest(F.col(text_col)) == side[k_sha])
    lost = base.stash(gone.filter("not any").select(k_id, k_sha))
    kept = docs.join(base.bounded(lost, 128), same(lost), "left_anti")
    twice = base.stash(gone.filter("any").select(k_id, k_sha))
    if twice.isEmpty():
        return kept
    one = base.bounded(twice, 128)
    ties = kept.join(one, same(twice), "left_semi").withColumn(k_sha, _digest(F.col(text_col))).dropDuplicates([id_col, k_sha]).drop(k_sha)
    return kept.join(one, same(twice), "left_anti").unionByName(ties)


@base.query(
    "op4_exact_dedup",
    f"""
    with t as (select doc_id, sha256(translate(coalesce(text, ''), '{base.UPPER}', '{base.LOWER}')) as text_sha256 from documents)
    select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
           doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
    from t
    """,
)
def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(base.table(spark, sf_dir, "documents"))
