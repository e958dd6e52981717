"""Sinks: upserts, frames with manifests, append-only ledgers, content-addressed snapshots, stable views."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality

#: Rows that a view for people may have; they are put together on the driver.
VIEW_ROWS = 100_000


def canonical_json(value, indent: int | None = None, sort: bool = True) -> str:
    """Text of a value that depends on nothing but the value; with an indent it ends in a line end."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=sort, indent=indent, separators=(",", ":") if indent is None else None, allow_nan=False)
    return text if indent is None else text + "\n"


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_with_manifest(df: DataFrame, path: str, publish: str = "blocked") -> dict:
    """CSV part files and a manifest of rows, columns, the files' SHA-256 and the publication gate. A folder that exists is refused."""
    export_csv(df, f"{path}/data")
    spark = df.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{path}/data")
    parts = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256")).orderBy("name").collect()
    rows = spark.read.option("header", True).schema(df.schema).csv(f"{path}/data").count()
    manifest = {"rows": rows, "columns": df.columns, "files": {r.name: r.sha256 for r in parts}, "publish_gate": publish}
    write_text(spark, f"{path}/manifest.json", canonical_json(manifest, indent=2))
    return manifest


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small file through Hadoop's file systems, wherever the path leads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(path, wholetext=True).first().value


def append_entry(spark: SparkSession, path: str, entry: dict, schema: str) -> dict:
    """Add an entry to an NDJSON ledger (a folder of files); its id and (reuse_key, observed_at) must be new."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        known = spark.read.schema(schema).json(path)
        same = (F.col("snapshot_id") == entry["snapshot_id"]) | ((F.col("reuse_key") == entry["reuse_key"]) & (F.col("observed_at") == entry["observed_at"]))
        if not known.filter(same).isEmpty():
            raise quality.QualityError(f"{entry['snapshot_id']} is not new")
    spark.createDataFrame([entry], schema).coalesce(1).write.mode("append").json(path)
    return entry


def write_snapshot(spark: SparkSession, folder: str, payload: dict, volatile: Sequence[str] = ("generated_at", "observed_at")) -> tuple[str, bool]:
    """Write a payload under its digest and point `latest.json` to it: (path, whether it is new).

    A payload that differs from the latest only in volatile keys is not written again.
    """
    stable = lambda p: {k: v for k, v in p.items() if k not in volatile}
    latest = read_text(spark, f"{folder}/latest.json")
    if latest:
        at = json.loads(latest)["path"]
        if stable(json.loads(read_text(spark, at))) == stable(payload):
            return at, False
    path = f"{folder}/{digest(payload)}.json"
    if read_text(spark, path) is None:
        write_text(spark, path, canonical_json(payload, indent=2))
    write_text(spark, f"{folder}/latest.json", canonical_json({"path": path, "sha256": digest(payload)}, indent=2), overwrite=True)
    return path, True


def stable_view(df: DataFrame, order: Sequence[str]) -> tuple[str, str]:
    """CSV and JSON texts of a small frame, the same bytes whenever the rows are the same. More than VIEW_ROWS rows fail."""
    rows = df.orderBy(*order).limit(VIEW_ROWS + 1).collect()
    if len(rows) > VIEW_ROWS:
        raise ValueError(f"a view has {VIEW_ROWS} rows at most")
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(df.columns)
    w.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue(), canonical_json([r.asDict(recursive=True) for r in rows], indent=2)


def markdown_view(df: DataFrame, order: Sequence[str]) -> str:
    rows = df.orderBy(*order).limit(VIEW_ROWS + 1).collect()
    if len(rows) > VIEW_ROWS:
        raise ValueError(f"a view has {VIEW_ROWS} rows at most")
    line = lambda xs: "| " + " | ".join("" if x is None else " + ".join(map(str, x)) if isinstance(x, list) else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)]) + "\n"
