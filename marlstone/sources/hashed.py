"""Tables dealt to folders by the hash of their key, so that an upsert rewrites only the folders that it changes.

path/v=<n>/__part=<p> holds part p as version n wrote it; path/pointers/<n> says for each part which version holds it. A version is there when its
pointer is, and neither is ever written over: readers of an older version keep what they read, and of two writers of the same version one fails.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..operators import relational as R

PART = "__part"
#: Folders of a new table.
PARTS = 64


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    p, fs = _folder(spark, f"{path}/pointers")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def pointer(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What the version's pointer says (the latest one's if none is named): parts, key, schema, and the version of each part that has rows; None without a table."""
    known = versions(spark, path)
    if not known:
        return None
    return json.loads(spark.read.text(f"{path}/pointers/{known[-1] if version is None else version}", wholetext=True).first().value)


def _publish(spark: SparkSession, path: str, version: int, value: dict) -> None:
    p, fs = _folder(spark, f"{path}/pointers/{version}")
    out = fs.create(p, False)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    finally:
        out.close()


def _parts(spark: SparkSession, path: str, at: dict, wanted: set[int] | None = None) -> DataFrame:
    """Rows with PART of the wanted parts: only their folders are read."""
    schema = T.StructType.fromJson(at["schema"]).add(PART, T.IntegerType())
    found = [f"{path}/v={v}/{PART}={p}" for p, v in sorted(at["versions"].items()) if wanted is None or int(p) in wanted]
    if not found:
        return spark.createDataFrame([], schema)
    part = F.regexp_extract(F.col("_metadata.file_path"), rf"{PART}=(\d+)", 1).cast("int")
    return spark.read.schema(T.StructType.fromJson(at["schema"])).parquet(*found).withColumn(PART, part)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at a version, the latest if none is named."""
    at = pointer(spark, path, version)
    if at is None:
        raise ValueError(f"no table at {path}")
    return _parts(spark, path, at).drop(PART)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], ordinal: str | None = None, parts: int = PARTS) -> int:
    """Put the rows of new in place of those with the same key; the version that then holds.

    Of repeated keys the row of the largest `ordinal` stays, or without one the last in the frame's order; null keys are keys. Only the folders that
    new's keys fall in are read, and of these only the ones whose rows change are written: where nothing changes, as in a repeated
    run, there is no new version. The first call makes the table, whose columns, key and number of folders then hold; a later
    frame must have the same columns. What comes to the driver is a number for each folder.
    """
    at = pointer(spark, path)
    if at is None:
        at = {"parts": parts, "key": list(key), "schema": new.schema.jsonValue(), "versions": {}}
    kinds = {f["name"]: f["type"] for f in at["schema"]["fields"]}
    if at["key"] != list(key) or kinds != {f.name: f.jsonValue()["type"] for f in new.schema}:
        raise ValueError("the table has another key or other columns")
    hashed = F.pmod(F.xxhash64(*(x for c in key for x in (F.col(c), F.col(c).isNull()))), F.lit(at["parts"])).cast("int")
    named = new.select(*kinds)
    rows = named.withColumn("__at", F.monotonically_increasing_id() if ordinal is None else F.col(ordinal))
    rows = storage.stash(R.last_wins(rows, key, "__at").drop("__at").withColumn(PART, hashed))
    touched = {r[0] for r in rows.select(PART).distinct().collect()}
    old = _parts(spark, path, at, touched)
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__new_{c}"))
    keys = rows.select(F.col(PART).alias("__of"), *(F.col(c).alias(f"__new_{c}") for c in key))
    merged = old.join(keys, same & (F.col(PART) == F.col("__of")), "left_anti").unionByName(rows)
    sums = lambda df, n: df.groupBy(PART).agg(*R.row_sums(list(kinds))).select(PART, F.struct("n", "a", "b").alias(n))
    changed = sorted(r[0] for r in sums(merged, "x").join(sums(old, "y"), PART, "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select(PART).collect())
    before = versions(spark, path)
    if not changed and before:
        return before[-1]
    version = before[-1] + 1 if before else 1
    out = merged.filter(F.col(PART).isin(changed)).hint("rebalance", F.col(PART))
    out.write.partitionBy(PART).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/v={version}")
    _publish(spark, path, version, at | {"versions": at["versions"] | {str(p): version for p in changed}})
    return version


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the pointers before the last `keep` ones and the folders that no pointer left names; how many folders."""
    known = versions(spark, path)
    for v in known[:-keep]:
        p, fs = _folder(spark, f"{path}/pointers/{v}")
        fs.delete(p, False)
    used = {(int(v), int(p)) for k in known[-keep:] for p, v in pointer(spark, path, k)["versions"].items()}
    gone = 0
    for v in known:
        p, fs = _folder(spark, f"{path}/v={v}")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = s.getPath().getName()
            if name.startswith(f"{PART}=") and (v, int(name.split("=")[1])) not in used:
                fs.delete(s.getPath(), True)
                gone += 1
    return gone
