"""What the operators share: registry, written tables, size-checked joins, native text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A side of a join is broadcast up to this many bytes; beyond, both sides shuffle.
BROADCAST_BYTES = 32 << 20

#: Bytes of a batch that goes to Python, where Python and the JVM hold it at the same time.
ARROW_BYTES = 4 << 20
_ARROW, _CLEANUP = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a Bloom filter for each of its keys, and at most; with more keys it lets more through, which costs work but changes no result.
BLOOM_BITS, BLOOM_MOST = 16, 1 << 28

_written: dict[str, list[str]] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, oracle: str | None = None):
    """Register a query, with its DuckDB twin if SQL can express it."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master, where there is one machine, may fall back to a temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. by: an int column whose values get folders of their own.

    The shuffle files of the stages that made it go when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stashed_at = path
    return back


def release(spark: SparkSession, keep: DataFrame | None = None) -> int:
    """Delete the tables that stash() has written in this application, once its results are stored. keep: one of them that stays. How many there were."""
    stays = getattr(keep, "_stashed_at", None)
    paths = _written.pop(spark.sparkContext.applicationId, [])
    if stays in paths:
        paths.remove(stays)
        _written[spark.sparkContext.applicationId] = [stays]
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def ship(spark: SparkSession) -> None:
    """Give the package's code to the executors. Arrow batches are of at most ARROW_BYTES unless the session says otherwise."""
    if spark.conf.get(_ARROW, None) is None:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    session.ship(spark)


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def bounded(small: DataFrame, row_bytes: int) -> DataFrame:
    """small with a broadcast hint if its rows (of a stashed table) fit; else without one."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def place(key: Column, bits: int) -> Column:
    """Where a key stands in a filter of so many bits."""
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits)) + 1


def bitmaps(places: DataFrame) -> DataFrame:
    """(bucket, bitmap) of a column of places; a bucket is 32,768 of them. Put together in the map tasks first."""
    return places.toDF("p").groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def probe(df: DataFrame, at: Column, maps: DataFrame, out: str) -> DataFrame:
    """df with a further boolean column: whether the bit at this place is set in maps, whose size must be bounded."""
    p, b, m = fresh(df, "probe_place", "probe_bucket", "probe_bitmap")
    side = F.broadcast(maps.select(F.col("bucket").alias(b), F.col("bitmap").alias(m)))
    found = df.withColumn(p, at).join(side, F.bitmap_bucket_number(p) == F.col(b), "left")
    return found.withColumn(out, bit(F.col(m), F.bitmap_bit_position(p))).drop(p, b, m)


def semi_first(rows: DataFrame, side: DataFrame, key: str, row_bytes: int = 64, how: str = "inner", size: int | None = None) -> DataFrame:
    """rows joined with side, a stashed table, on a column that both have. size: the bytes of side, else its rows times row_bytes.

    If side doesn't fit in a broadcast, a Bloom filter of its keys, of BLOOM_MOST bits at most, goes first, so that of rows
    without a partner only the filter's few errors shuffle; with how='left' the others pass with nulls.
    """
    n = side.count()
    if (n * row_bytes if size is None else size) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), key, how)
    bits = min(BLOOM_MOST, 1 << max(16, (n * BLOOM_BITS - 1).bit_length()))
    maps = stash(bitmaps(side.select(place(F.col(key), bits))))
    (maybe,) = fresh(rows, "maybe")
    probed = probe(rows, place(F.col(key), bits), maps, maybe)
    joined = probed.filter(maybe).drop(maybe).join(side, key, how)
    if how == "left":
        joined = joined.unionByName(probed.filter(~F.col(maybe)).drop(maybe), allowMissingColumns=True)
    return joined


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the faster function, with the same result."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """The rows that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def row_key(ident: Column, text: Column) -> Column:
    """64 bits by which a row with this id and text is found again; nulls count as such."""
    return F.xxhash64(ident.cast("string"), ident.isNull(), text)


def first_of_each(df: DataFrame, key: str, ident: str, n: int, slots: int = 4096) -> DataFrame:
    """The first n rows of each key in the order of a hash of ident, ties by ident.

    Rows are first counted by key and slot of the hash, combined in the map tasks; only rows of the slots that hold the first n are ranked, so
    that the task of a key meets n rows and a slot's share of the others, however many rows the key has.
    """
    h = F.xxhash64(ident)
    (slot,), columns = fresh(df, "slot"), df.columns
    df = df.withColumn(slot, F.floor(h / (2.0**64 / slots)).cast("int"))
    counts = df.groupBy(key, slot).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = stash(counts.withColumn("__b", before).filter(F.col("__b") < n).groupBy(key).agg(F.max(slot).alias("__last")))
    near = df.join(bounded(last, 64), key).filter(F.col(slot) <= F.col("__last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(h, ident))
    return near.withColumn("__place", place).filter(F.col("__place") <= n).select(*columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def bit(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap_construct_agg bitmap is set; a null bitmap has none."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def input_bytes(df: DataFrame, default: int = 0) -> int:
    """Catalyst's estimate of df's size; default where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else default


def partitions(df: DataFrame, per: int) -> int:
    """Shuffle partitions for df: its estimated bytes / per, at least the session's number.

    With no estimate, the session's number; it is what the cluster was set up for.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // per))
