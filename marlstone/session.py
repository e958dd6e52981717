"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "marlstone", cpus: str | int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "8"
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("MARLSTONE_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the directory may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package's code to the executors, once in a session, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_marlstone_shipped", False):
        return
    top = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="marlstone-code-"), "marlstone_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    context.addPyFile(out)
    context._marlstone_shipped = True


def shipped(df: DataFrame) -> DataFrame:
    """df, after the package's code has gone to the executors: for functions whose Python workers call it."""
    ship(df.sparkSession)
    return df
