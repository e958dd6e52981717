"""Ingestion whose memory is bounded in time: known ids expire, and counts by reason come out on timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import ship

#: Groups that ids are dealt to: each has a map of its ids and a map of its counts.
BUCKETS = 64
#: What happened to a row. An id that is older than `fresh_ms`, but not yet forgotten, is taken again.
NEW, AGAIN, KNOWN = "new", "again", "known"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KIND, REASON, N, AT = "__kind", "__reason", "__n", "__at"


class Admission(StatefulProcessor):
    """Rows of a bucket: admitted ones go on, all are counted by reason, and the counts come out once in `report_ms`.

    Rows hold bucket, ident, refused, and c0, c1, ... for the stream's columns, whose names may clash with these.
    """

    def __init__(self, columns: int, ttl_ms: int, fresh_ms: int, report_ms: int):
        self.columns, self.ttl_ms, self.fresh_ms, self.report_ms = [f"c{i}" for i in range(columns)], ttl_ms, fresh_ms, report_ms
        self._out = Row(*self.columns, "kind", "reason", "n", "at")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "id string", "at long", ttlDurationMs=self.ttl_ms)
        self.counts = handle.getMapState("counts", "reason string", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, counts, due = timerValues.getCurrentProcessingTimeInMs(), {}, False
        for r in rows:
            reason = r["refused"] if r["refused"] is not None else self._judge(r["ident"], now)
            counts[reason] = counts.get(reason, 0) + 1
            if reason in (NEW, AGAIN):
                yield self._out(*(r[c] for c in self.columns), "row", reason, 1, now)
        for reason, n in counts.items():
            before = self.counts.getValue((reason,)) if self.counts.containsKey((reason,)) else None
            due = due or before is None
            self.counts.updateValue((reason,), ((before[0] if before else 0) + n,))
        if due and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(now + self.report_ms)

    def _judge(self, ident: str, now: int) -> str:
        at = self.seen.getValue((ident,))[0] if self.seen.containsKey((ident,)) else None
        if at is not None and now - at < self.fresh_ms:
            return KNOWN
        self.seen.updateValue((ident,), (now,))
        return NEW if at is None else AGAIN

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = [(k[0], v[0]) for k, v in self.counts.iterator()]
        self.counts.clear()
        for reason, n in found:
            yield self._out(*[None] * len(self.columns), "count", reason, n, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def admit(stream: DataFrame, key: str, ttl_ms: int, fresh_ms: int | None = None, report_ms: int = 60_000, refuse: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows with __kind, __reason, __n and __at (processing time in ms): `row` for those that are admitted, `count` for how many had a reason since the last report.

    An id is known for fresh_ms (ttl_ms if not given) after it was admitted, and forgotten after ttl_ms, so that the state holds the ids of
    that time and no more. refuse: a text column that isn't null where a row is to be refused for this reason; a null or empty id is `no_id`.
    Repeated ids in a batch are known from the second on. Ids are dealt to `buckets` groups by their hash, so that a hot source is no hot group.
    """
    ship(stream.sparkSession)
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    refused = F.when(ident == "", F.lit("no_id"))
    refused = refused if refuse is None else F.coalesce(refuse.cast("string"), refused)
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(stream.columns)]
    rows = stream.select(F.pmod(F.xxhash64(ident), F.lit(buckets)).cast("int").alias("bucket"), ident.alias("ident"), refused.alias("refused"), *columns)
    more = {"kind": T.StringType(), "reason": T.StringType(), "n": T.LongType(), "at": T.LongType()}
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(stream.schema)] + [T.StructField(n, t) for n, t in more.items()])
    processor = Admission(len(columns), ttl_ms, ttl_ms if fresh_ms is None else fresh_ms, report_ms)
    found = rows.groupBy("bucket").transformWithState(processor, schema, "Update", "ProcessingTime")
    return found.toDF(*stream.columns, KIND, REASON, N, AT)


def ingest(stream: DataFrame, key: str, out: str, checkpoint: str, every: str | None = None, **options) -> StreamingQuery:
    """Append admitted rows to out/rows/batch=<n> and counts to out/counts/batch=<n>: all that is there in one batch, or, with a time like '1 minute', a batch each.

    (`availableNow` would not end: while there are timers by processing time there is always a batch to run.) A batch that is run again writes over its own folders; state and timers come back from the checkpoint. Timers that are due when the
    query starts fire with its first batch, which runs even if no rows have come. Sets the session's state store to RocksDB, which keyed maps need.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    found = admit(stream, key, **options)

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        df.filter(F.col(KIND) == "row").drop(KIND, REASON, N, AT).write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
        df.filter(F.col(KIND) == "count").groupBy(REASON).agg(F.sum(N).alias("n")).withColumnRenamed(REASON, "reason").write.mode("overwrite").parquet(f"{out}/counts/batch={batch}")
        df.unpersist()

    return found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"once": True})).start()


def audit(spark: SparkSession, out: str) -> DataFrame:
    """(reason, n) over all reports so far."""
    return spark.read.parquet(f"{out}/counts").groupBy("reason").agg(F.sum("n").alias("n"))
