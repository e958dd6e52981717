"""Deep pages of an ordered table: rows lie in ranges of the order whose counts say where a page begins."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan

#: Ranges of an index.
RANGES = 1024
RANGE = "__seg"


@dataclass(frozen=True)
class RankIndex:
    """table: the rows with the number of their range, a file for each. counts: rows of each range, in order."""

    table: DataFrame
    order: tuple[str, ...]
    counts: tuple[int, ...]

    @property
    def rows(self) -> int:
        return sum(self.counts)

    def pages(self, size: int = 50) -> int:
        return -(-self.rows // size)

    def slice(self, first: int, n: int, descending: bool = False) -> DataFrame:
        """Rows first .. first + n - 1 of the order (nulls first), or of its reverse, from 0: only the ranges that hold them are read and sorted."""
        last = min(first + n, self.rows)
        first = max(0, min(first, last))
        if descending:
            first, last = self.rows - last, self.rows - first
        wanted, skip, at = [], 0, 0
        for i, count in enumerate(self.counts):
            if at < last and at + count > first:
                skip = skip if wanted else first - at
                wanted.append(i)
            at += count
        if not wanted:
            return self.table.filter(F.lit(False)).drop(RANGE)
        found = self.table.filter(F.col(RANGE).isin(wanted)).orderBy(*self.order).offset(skip).limit(last - first).drop(RANGE)
        return found.orderBy(*(F.col(c).desc() for c in self.order)) if descending else found

    def page(self, number: int, size: int = 50, descending: bool = False) -> DataFrame:
        """Page `number`, from 1; none beyond the last."""
        return self.slice((number - 1) * size, size, descending)


def build(df: DataFrame, order: Sequence[str], path: str, ranges: int = RANGES) -> RankIndex:
    """Write df below path in at most `ranges` ranges of the order, whose bounds come from a sample; the order should be total, else ties come in any order.

    The counts, one number for each range, are the only thing that comes to the driver besides the sample.
    """
    s = scan.segments(df, [], list(order), ranges)
    s.dealt().sortWithinPartitions(*order).write.parquet(f"{path}/table")
    spark = df.sparkSession
    table = spark.read.schema(s.rows.schema).parquet(f"{path}/table")
    found = {r[RANGE]: r["n"] for r in table.groupBy(RANGE).agg(F.count("*").alias("n")).collect()}
    counts = [found.get(i, 0) for i in range(s.parts)]
    spark.createDataFrame([(json.dumps({"order": list(order), "counts": counts}),)], "value string").coalesce(1).write.text(f"{path}/counts")
    return RankIndex(table, tuple(order), tuple(counts))


def read(spark: SparkSession, path: str) -> RankIndex:
    at = json.loads(spark.read.text(f"{path}/counts").first().value)
    return RankIndex(spark.read.parquet(f"{path}/table"), tuple(at["order"]), tuple(at["counts"]))
