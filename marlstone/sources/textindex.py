"""A stored trigram index: text searches read the blocks of rows that can match, and verify them.

The table is written in blocks of consecutive rows; postings say for each trigram of the lower-cased texts which blocks hold it, as bitmaps. A
pattern's trigrams are looked up, their bitmaps intersected, and the candidate blocks are a filter on the table's block column, which
Parquet answers from the statistics of its row groups. Patterns without three letters in a row read the whole table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

#: Rows of a block, and blocks of a bitmap (Spark's bitmap functions have 32,768 bits).
BLOCK_ROWS, BITMAP = 4096, 32_768
#: Candidate blocks that become constants of a filter; more are joined.
CONSTANTS = 4096
#: Bytes of a row group of the table and of the postings, the unit that a filter skips.
ROW_GROUP, POSTINGS_GROUP = 8 << 20, 1 << 20
BLOCK = "__block"


def grams(text: str) -> list[str]:
    """The distinct trigrams of a text's lower case that every text with it has in its own: not those with a sigma, whose lower case depends on what follows."""
    low = text.lower()
    return sorted({g for i in range(len(low) - 2) if not set(g := low[i : i + 3]) & set("σς")})


def _grams_of(text: Column) -> Column:
    """The same of a column: characters are split once, so that long texts take time in proportion to their length."""
    characters = F.split(F.lower(F.coalesce(text, F.lit(""))), "")
    three = lambda c: F.when(F.size(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(F.array_remove(characters, "")), three), 1)


def like_parts(pattern: str) -> list[str]:
    """The literal runs of a LIKE pattern, whose escape is a backslash."""
    runs = [""]
    for escaped, wild, plain in re.findall(r"\\(.)|([%_])|(.)", pattern, re.DOTALL):
        runs[-1] += escaped or plain
        runs += [""] * bool(wild)
    return [x for x in runs if x]


@dataclass(frozen=True)
class TextIndex:
    """table: the rows with BLOCK, in its order. postings: (column, gram, part, bitmap of the part's blocks)."""

    table: DataFrame
    postings: DataFrame
    columns: tuple[str, ...]

    def candidates(self, wanted: Sequence[tuple[str, str]]) -> DataFrame | None:
        """(BLOCK) of the blocks in which a column of one of the (column, literal) pairs has all of the literal's trigrams; None if one has no trigram."""
        each = [(c, grams(text)) for c, text in wanted]
        if any(not g for _, g in each):
            return None
        found = []
        for c, gs in each:
            hits = self.postings.filter((F.col("column") == c) & F.col("gram").isin(gs)).groupBy("part").agg(F.count("*").alias("n"), F.bitmap_and_agg("bitmap").alias("bitmap"))
            found.append(hits.filter(F.col("n") == len(gs)).select("part", "bitmap"))
        parts = reduce(DataFrame.unionByName, found).groupBy("part").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        byte = lambda i: F.conv(F.hex(F.substring("bitmap", F.floor(i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bits = parts.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(BITMAP - 1))))
        return bits.filter(F.call_function("shiftright", byte(F.col("bit")), F.col("bit") % 8).bitwiseAND(1) == 1).select(((F.col("part") - 1) * BITMAP + F.col("bit")).alias(BLOCK))

    def rows(self, wanted: Sequence[tuple[str, str]]) -> DataFrame:
        """The table's rows in candidate blocks, not yet verified."""
        found = self.candidates(wanted)
        if found is None:
            return self.table
        few = [r[0] for r in found.limit(CONSTANTS + 1).collect()]
        if len(few) > CONSTANTS:
            return self.table.join(found, BLOCK, "left_semi")
        return self.table.filter(F.col(BLOCK).isin(few)) if few else self.table.filter(F.lit(False))

    def search(self, q: str, exact: Sequence[str] = (), folded: Sequence[str] = ()) -> DataFrame:
        """Rows of which a column of `exact` contains q, or one of `folded` without regard to case; an empty q gives all."""
        if not q:
            return self.table.drop(BLOCK)
        self._known([*exact, *folded])
        holds = [F.col(c).contains(q) for c in exact] + [F.lower(c).contains(q.lower()) for c in folded]
        return self.rows([(c, q) for c in (*exact, *folded)]).filter(reduce(lambda a, b: a | b, holds)).drop(BLOCK)

    def ilike(self, column: str, pattern: str) -> DataFrame:
        """Rows whose column matches a LIKE pattern without regard to case; its longest literal run chooses the blocks."""
        self._known([column])
        literal = max(like_parts(pattern), key=len, default="")
        return self.rows([(column, literal)]).filter(F.col(column).ilike(pattern)).drop(BLOCK)

    def _known(self, columns: Sequence[str]) -> None:
        if lacking := set(columns) - set(self.columns):
            raise ValueError(f"not indexed: {sorted(lacking)}")


def build(df: DataFrame, columns: Sequence[str], path: str, block_rows: int = BLOCK_ROWS, row_group: int = ROW_GROUP) -> TextIndex:
    """Write df and the postings of its text columns below path.

    Rows keep their order in each of df's partitions. The postings are combined in the map tasks: what shuffles is a bitmap for each
    task, trigram and 32,768 blocks. A null text has no trigrams. Blocks are numbered without gaps from one count for each partition.
    """
    raw = storage.stash(df.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.call_function("shiftright", F.col("__at"), F.lit(33)), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = raw.groupBy(part.alias("p")).agg((F.floor(F.max(place) / block_rows) + 1).alias("n")).collect()
    starts, total = [], 0
    for r in sorted(counts):
        starts.append((r.p, total))
        total += r.n
    first = raw.sparkSession.createDataFrame(starts, "__p long, __first long")
    blocks = raw.withColumn("__p", part).join(F.broadcast(first), "__p").withColumn(BLOCK, F.col("__first") + F.floor(place / block_rows)).drop("__p", "__first", "__at")
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks.repartitionByRange(parts, BLOCK).sortWithinPartitions(BLOCK).write.option("parquet.block.size", row_group).option("parquet.block.size.row.check.min", min(block_rows, 100)).parquet(f"{path}/table")
    table = raw.sparkSession.read.parquet(f"{path}/table")
    each = [table.select(F.lit(c).alias("column"), BLOCK, F.explode(_grams_of(F.col(c))).alias("gram")) for c in columns]
    bit, number = F.bitmap_bit_position(F.col(BLOCK) + 1), F.bitmap_bucket_number(F.col(BLOCK) + 1)
    postings = reduce(DataFrame.unionByName, each).groupBy("column", "gram", number.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))
    postings.repartitionByRange(parts, "column", "gram").sortWithinPartitions("column", "gram").write.option("parquet.block.size", POSTINGS_GROUP).parquet(f"{path}/postings")
    return read(raw.sparkSession, path)


def read(spark: SparkSession, path: str) -> TextIndex:
    postings = spark.read.parquet(f"{path}/postings")
    columns = tuple(sorted(r[0] for r in postings.select("column").distinct().collect()))
    return TextIndex(spark.read.parquet(f"{path}/table"), postings, columns)
