"""Streaming forms of the incremental jobs: exactly-once appends of new documents, windows with late data, sessions, state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import anti_known


def watch(spark: SparkSession, path: str, schema, kind: str = "parquet", files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(kind).load(path)


def ingest(stream: DataFrame, key: str, out: str, checkpoint: str, time: str | None = None, late: str = "1 day", known: DataFrame | None = None) -> StreamingQuery:
    """Append documents whose key is new to out/batch=<n>, and stop when all that is there is read.

    Keys are remembered in the state store; with a time column, only as long as rows may be late. A batch that is run again writes
    over its own folder, so that nothing comes twice.
    """
    if known is not None:
        stream = anti_known(stream, known, [key])
    fresh = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else stream.dropDuplicates([key])

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("batch").agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str, width: str, key: list[str], *aggregates: Column, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates over event-time windows, tumbling or sliding, that take late rows up to the watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *key).agg(*aggregates)


def session_counts(stream: DataFrame, time: str, gap: str, key: list[str], late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *key).agg(F.count("*").alias("n"))


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) so far, after every batch that has rows of the key: state that a plain aggregate can't hand on in append mode."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "total": [total]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"key {kind}, n long, total double", "n long, total double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all that is there into Parquet."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
