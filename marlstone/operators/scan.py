"""Scans over long ordered series: a series is cut into segments in the order of (key, time), which are worked on apart.

A window by key gives each key one task. Here the boundaries of `parts` segments are drawn from a sample of the keys and times, so that a key
of any size is spread over as many segments as its share of the rows. What a segment needs of those before it is small: the
last rows of the segment before (`windowed`), or one summary that a monoid combines (`scan`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import storage

#: Rows of the sample for each segment: the largest segment is then about a third above the mean.
SAMPLE = 100
_SEG, _HALO, _RANK = "__seg", "__halo", "__rank"


def names(time: str | Sequence[str]) -> list[str]:
    return [time] if isinstance(time, str) else list(time)


@dataclass(frozen=True)
class Segments:
    """rows: a stored table with its segment's number, a step function of (key, time): rows that tie are in one segment."""

    rows: DataFrame
    key: list[str]
    time: list[str]
    parts: int

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(_SEG, *self.key).orderBy(*self.time)

    def dealt(self, rows: DataFrame | None = None) -> DataFrame:
        """Each segment in a partition of its own."""
        return (self.rows if rows is None else rows).repartitionById(self.parts, F.col(_SEG))


def _at(columns: Sequence[str | Column]) -> Column:
    return F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)))


def segments(df: DataFrame, key: Sequence[str], time: str | Sequence[str], parts: int | None = None) -> Segments:
    """df, stored, in at most `parts` segments (the session's shuffle partitions).

    Nulls come first, as in a window's order. At most parts * SAMPLE positions come to the driver, as text; the boundaries that
    they give are constants of the plan, so that every pass over the rows cuts them alike.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*key, *names(time)]
    stored = storage.stash(df)
    n = stored.count()
    drawn = stored.select(_at(order).alias("at"), *(F.col(c).cast("string").alias(f"s{i}") for i, c in enumerate(order)))
    drawn = drawn.sample(min(1.0, parts * SAMPLE / max(1, n)), seed=1)
    found = drawn.agg(F.sort_array(F.collect_list(F.struct("at", *(f"s{i}" for i in range(len(order)))))).alias("all")).select(F.transform("all", lambda x: F.array(*(x[f"s{i}"] for i in range(len(order))))).alias("s")).first()["s"]
    every = max(1.0, len(found) / parts)
    bounds = list(dict.fromkeys(tuple(found[int(i * every)]) for i in range(1, parts) if int(i * every) < len(found)))
    kinds = [stored.schema[c].dataType for c in order]
    here = _at(order)

    def number(low: int, high: int) -> Column:
        """Of the segments low..high the one that holds the row, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        bound = _at([F.lit(v).cast(t) for v, t in zip(bounds[middle - 1], kinds, strict=True)])
        return F.when(here >= bound, number(middle, high)).otherwise(number(low, middle - 1))

    return Segments(stored.withColumn(_SEG, number(0, len(bounds))), list(key), names(time), len(bounds) + 1)


def windowed(df: DataFrame, key: Sequence[str], time: str | Sequence[str], columns: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0, parts: int | None = None) -> DataFrame:
    """df with columns(w), whose frames reach at most `before` rows back and `after` rows ahead of a row.

    Each segment gets copies of the last `before` rows of those before it and of the first `after` rows of those behind it, so that its windows are
    complete; the copies are at most parts * (before + after) rows.
    """
    s = segments(df, key, time, parts)
    sizes = {r[_SEG]: r["n"] for r in s.rows.groupBy(_SEG).agg(F.count("*").alias("n")).collect()}
    rows = s.rows.withColumn(_HALO, F.lit(False))
    for most, there in ((before, sorted(sizes)), (after, sorted(sizes, reverse=True))):
        if most and len(there) > 1:
            rows = rows.unionByName(_halo(s, most, there, sizes, ahead=there[0] > there[-1]))
    return s.dealt(rows).withColumns(columns(s.window)).filter(~F.col(_HALO)).drop(_SEG, _HALO)


def _halo(s: Segments, most: int, there: list[int], sizes: dict[int, int], ahead: bool) -> DataFrame:
    """Copies of the rows that are next to each segment: from several segments where some are shorter than `most`."""
    targets = []
    for i, to in enumerate(there):
        skip = 0
        for of in reversed(there[:i]):
            if skip >= most:
                break
            targets.append((of, to, skip))
            skip += sizes[of]
    order = [F.col(c).asc() if ahead else F.col(c).desc() for c in (*s.key, *s.time)]
    edge = s.dealt().withColumn(_RANK, F.row_number().over(Window.partitionBy(_SEG).orderBy(*order))).filter(F.col(_RANK) <= most)
    side = F.broadcast(s.rows.sparkSession.createDataFrame(targets, "__of int, __to int, __skip int"))
    copies = edge.join(side, (F.col(_SEG) == F.col("__of")) & (F.col(_RANK) + F.col("__skip") <= most))
    return copies.withColumn(_SEG, F.col("__to")).withColumn(_HALO, F.lit(True)).drop(_RANK, "__of", "__to", "__skip")


def scan(
    df: DataFrame, key: Sequence[str], time: str | Sequence[str],
    local: Callable[[WindowSpec], dict[str, Column]], summary: dict[str, Column], combine: Callable[[Column, Column], dict[str, Column]], finish: Callable[[Column], dict[str, Column]], parts: int | None = None,
) -> DataFrame:
    """df with the columns that finish(carry) gives, for functions of all rows up to each.

    local: columns over the segment's part of the key, each of which may use those before it; dropped at the end. summary: aggregates of these, a value of a monoid for each segment.
    combine(a, b): the value of a segment behind another's, field by field. finish gets the combined value of all segments of the key before
    the row's, null if it has none. One summary a segment is combined in one task: as many rows as there are segments.
    """
    s = segments(df, key, time, parts)
    rows = s.dealt()
    added = local(s.window)
    for n, c in added.items():
        rows = rows.withColumn(n, c)
    fields = list(summary)
    each = rows.groupBy(_SEG, *s.key).agg(F.struct(*(c.alias(n) for n, c in summary.items())).alias("__s"))
    name = F.struct(F.lit(0).alias("k"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(s.key)))
    last = each.withColumn("__k", name).groupBy(_SEG).agg(F.max("__k").alias("k"), F.max_by("__s", "__k").alias("s"), F.count("*").alias("n"))
    k_type, s_type = last.schema["k"].dataType, last.schema["s"].dataType
    value = lambda d: F.struct(*(d[n].alias(n) for n in fields))
    state = lambda out, k, v, has: F.struct(out.alias("out"), k.alias("k"), v.alias("s"), has.alias("has"))

    def step(a: Column, x: Column) -> Column:
        goes_on = a["has"] & (x["n"] == 1) & a["k"].eqNullSafe(x["k"])
        return state(F.concat(a["out"], F.array(F.struct(x[_SEG].alias("seg"), a["k"].alias("k"), a["s"].alias("s")))), x["k"], F.when(goes_on, value(combine(a["s"], x["s"]))).otherwise(x["s"]), F.lit(True))

    none = F.lit(None)
    carried = f"array<struct<seg:int,k:{k_type.simpleString()},s:{s_type.simpleString()}>>"
    start = state(F.array().cast(carried), none.cast(k_type), none.cast(s_type), F.lit(False))
    folded = last.agg(F.sort_array(F.collect_list(F.struct(_SEG, "n", "k", "s"))).alias("all")).select(F.explode(F.aggregate("all", start, step, lambda a: a["out"])).alias("c"))
    side = storage.stash(folded.select(F.col("c.seg").alias("__of"), F.col("c.k").alias("__k"), F.col("c.s").alias("__carry")).filter("__k IS NOT NULL"))
    out = rows.join(F.broadcast(side), (F.col(_SEG) == F.col("__of")) & name.eqNullSafe(F.col("__k")), "left")
    return out.withColumns(finish(F.col("__carry"))).drop(_SEG, "__of", "__k", "__carry", *added)


def whole(df: DataFrame, key: Sequence[str], **aggregates: Column) -> DataFrame:
    """df with aggregates over all rows of its key, or of the table; combined in the map tasks and joined back."""
    if not key:
        found = df.agg(*(c.alias(n) for n, c in aggregates.items())).first()
        return df.withColumns({n: F.lit(found[n]) for n in aggregates})
    side = df.groupBy(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(key))).agg(*(c.alias(n) for n, c in aggregates.items()))
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return df.join(side, same).drop(*(f"__k{i}" for i in range(len(key))))
