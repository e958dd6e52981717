"""Relational kernel: latest and first per key, diffs, classification, cross-tabs, search pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.textindex import TextIndex
from .scan import scan

#: Rows and bytes of a side that a join may broadcast without asking Catalyst; larger sides are left to it.
SMALL_ROWS, SMALL_BYTES = 100_000, 32 << 20


def small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and, written as JSON, bytes; looking takes one row more than that."""
    found = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found.n <= rows and found.b <= size else df


def keep_row(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order; Spark prunes to n in the map tasks before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def latest_per_key(df: DataFrame, key: Sequence[str], time: str, ordinal: str | None = None) -> DataFrame:
    """The row of the latest time of each key; of equal times the first by `ordinal`."""
    return keep_row(df, key, [F.col(time).desc_nulls_last(), *([F.col(ordinal).asc()] if ordinal else [])])


def last_n_per_key(df: DataFrame, key: Sequence[str], time: str, n: int = 5, ordinal: str | None = None) -> DataFrame:
    return keep_row(df, key, [F.col(time).desc_nulls_last(), *([F.col(ordinal).desc()] if ordinal else [])], n)


def first_wins(df: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    return keep_row(df, key, [F.col(ordinal).asc()])


def last_wins(df: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    return keep_row(df, key, [F.col(ordinal).desc()])


def as_of(df: DataFrame, key: Sequence[str], time: str, cutoff: Column, values: Sequence[str], version: str | None = None) -> DataFrame:
    """Of each key the values of the latest row up to a cutoff; an aggregate, so combined in the map tasks."""
    by = F.struct(time, *([version] if version else []))
    return df.filter(F.col(time) <= cutoff).groupBy(*key).agg(*(F.max_by(v, by).alias(v) for v in values))


def as_of_join(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, right_time: str, values: Sequence[str], parts: int | None = None) -> DataFrame:
    """Each left row with the values of the right row of its key that is latest at its time.

    Both sides are cut into segments of (key, time) together; each segment takes the last right row before it from those in front of it,
    so that a key of any size is spread over as many tasks as it has rows for.
    """
    none, held = lambda v: F.lit(None).cast(right.schema[v].dataType), F.struct(*(F.col(f"__v_{v}").alias(v) for v in values))
    l = left.withColumns({"__t": F.col(time), "__r": F.lit(1), **{f"__v_{v}": none(v) for v in values}})
    r = right.select(*key, F.col(right_time).alias("__t"), F.lit(0).alias("__r"), *(F.col(v).alias(f"__v_{v}") for v in values))
    both = scan(
        l.unionByName(r, allowMissingColumns=True), key, ["__t", "__r"],
        local=lambda w: {"__x": F.last(F.when(F.col("__r") == 0, held), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))},
        summary={"x": F.max_by("__x", F.struct("__t", "__r"))},
        combine=lambda a, b: {"x": F.coalesce(b["x"], a["x"])}, finish=lambda c: {"__last": F.coalesce(F.col("__x"), c["x"])}, parts=parts,
    )
    return both.filter("__r = 1").select(*left.columns, *(F.col("__last")[v].alias(v) for v in values))


#: Cells that a range join's axis is cut into, as a power of 2, and how much smaller than a range its smallest nodes may be.
CELL_BITS, NODE_BITS = 40, 3


def _axis(kinds: set[str]) -> Callable[[Column], Column]:
    """A function that keeps the order of such values, as a double."""
    if kinds <= {"date", "timestamp", "timestamp_ntz"}:
        if len(kinds) > 1:
            one = "timestamp" if "timestamp" in kinds else "timestamp_ntz"
            return lambda c: _axis({one})(c.cast(one))
        if kinds == {"date"}:
            return lambda c: F.unix_date(c).cast("double")
        if kinds == {"timestamp"}:
            return lambda c: F.unix_micros(c).cast("double")
        day = lambda c: F.unix_date(c.cast("date")) * F.lit(86_400e6)
        return lambda c: day(c) + (F.hour(c) * 3600 + F.minute(c) * 60) * F.lit(1e6) + F.extract(F.lit("SECOND"), c).cast("double") * 1e6
    return lambda c: c.cast("double")


def _nodes(low: Column, high: Column, least: Column) -> Column:
    """The nodes of a binary tree that cover the cells low..high of 2^least of the least ones: (level, index) structs, two a level at most.

    A range of at most 2^(NODE_BITS + 1) + 1 cells has no node above that level. The arguments are columns of the table: as expressions they would be worked out anew in every place.
    """
    shift = lambda c, n: F.call_function("shiftright", c, F.lit(n))
    found = []
    for i in range(NODE_BITS + 2):
        left, right = shift(low + ((1 << i) - 1), i), shift(high + 1, i) - 1
        node = lambda index: F.struct((least + i).alias("level"), index.alias("index"))  # noqa: B023, E731
        found += [F.when((left <= right) & (left % 2 == 1), node(left)), F.when((left <= right) & (right % 2 == 0), node(right))]
    return F.array_compact(F.array(*found))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """Points with the half-open ranges that hold them; nulls and empty ranges hold nothing.

    The axis is a binary tree over 2^CELL_BITS cells from the least to the largest bound. A range becomes the few nodes that cover it, from an
    eighth of its width up; a point its ancestors on the levels that any range uses. So ranges of all widths meet their points by an
    equi-join on nodes, each pair once, and the bounds themselves are compared last. Neither side is compared row by row with the other. The
    nodes are broadcast if they are small; else both sides shuffle, and a node that holds much of the points is split by AQE.
    """
    kinds = {dict(points.dtypes)[at], *(dict(ranges.dtypes)[c] for c in (low, high))}
    number = _axis(kinds)
    ranges = ranges.filter(F.col(low) < F.col(high))
    ends = F.array(number(F.col(low)), number(F.col(high)))
    bounds = ranges.select(F.explode(F.filter(ends, lambda x: F.abs(x) < float("inf"))).alias("x")).agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    first, last = (bounds.a, bounds.b) if bounds.a is not None else (0.0, 0.0)
    scale = 2.0**CELL_BITS / (last - first) if last > first else 0.0
    top = F.lit((1 << CELL_BITS) - 1)
    cell = lambda x: F.when(x >= last, top).when(x <= first, F.lit(0)).otherwise(F.least(top, F.floor((x - F.lit(first)) * F.lit(scale))))
    name = lambda level, index: level.cast("long") * (1 << 52) + index
    at_least = lambda c: F.call_function("shiftright", F.col(c), F.col("__least"))
    ends = ranges.withColumns({"__a": number(F.col(low)), "__b": number(F.col(high))}).withColumns({"__a": cell(F.col("__a")), "__b": cell(F.col("__b"))})
    ends = ends.withColumn("__least", F.greatest(F.lit(0), F.floor(F.log2(F.col("__b") - F.col("__a") + 1)).cast("int") - NODE_BITS)).withColumns({"__a": at_least("__a"), "__b": at_least("__b")})
    covered = ends.withColumn("__node", F.explode(_nodes(F.col("__a"), F.col("__b"), F.col("__least")))).drop("__a", "__b", "__least")
    levels = sorted(r[0] for r in covered.select("__node.level").distinct().collect())
    covered = covered.withColumn("__node", name(F.col("__node.level"), F.col("__node.index")))
    here = F.array(*(name(F.lit(n), F.call_function("shiftright", F.col("__cell"), F.lit(n))) for n in levels)) if levels else F.array().cast("array<bigint>")
    spread = points.filter(F.col(at).isNotNull()).withColumn("__cell", cell(number(F.col(at)))).withColumn("__node", F.explode(here)).drop("__cell")
    return spread.join(small(covered), "__node").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__node")


def range_sums(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, key: Sequence[str], **sums: Column) -> DataFrame:
    """For each key of the ranges the sums, of whole numbers of the points, over the points that its half-open ranges hold: a point once for each range. Nulls and empty ranges hold nothing; keys of empty ranges alone are left out.

    A range's sum is the total of all points before its upper bound less the total of those before its lower one. Points and bounds are put in one
    order, in segments, for one running total: a row for each point and two for each range, however many points a range holds.
    """
    bound = lambda c, sign: F.struct(F.col(c).alias("at"), F.lit(sign).alias("sign"))
    ends = ranges.filter(F.col(low) < F.col(high)).select(*key, F.explode(F.array(bound(low, -1), bound(high, 1))).alias("__end"))
    ends = ends.select(*key, F.col("__end.at").alias("__at"), F.lit(0).alias("__point"), F.col("__end.sign").alias("__sign"))
    held = points.filter(F.col(at).isNotNull()).select(F.col(at).alias("__at"), F.lit(1).alias("__point"), *(c.cast("long").alias(f"__v_{n}") for n, c in sums.items()))
    whole = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    totals = scan(
        ends.unionByName(held, allowMissingColumns=True), [], ["__at", "__point"],  # a bound stands before the points that lie on it
        local=lambda w: {f"__t_{n}": whole(F.sum(f"__v_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0))) for n in sums},
        summary={n: whole(F.sum(f"__v_{n}")) for n in sums},
        combine=lambda a, b: {n: (a[n] + b[n]).alias(n) for n in sums}, finish=lambda c: {f"__s_{n}": F.col(f"__t_{n}") + whole(c[n]) for n in sums},
    )
    return totals.filter("__point = 0").groupBy(*key).agg(*(F.sum(F.col("__sign") * F.col(f"__s_{n}")).alias(n) for n in sums))


def anti_known(df: DataFrame, known: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(known.select(*key).distinct(), list(key), "left_anti")


def semi(df: DataFrame, targets: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(targets.select(*key), list(key), "left_semi")


def membership(df: DataFrame, sets: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """df joined with rows of sets whose arrays hold its values, for every (column, array) of pairs: exploded, then an equi-join."""
    for array in pairs.values():
        sets = sets.withColumn(f"__{array}", F.explode(F.array_distinct(array)))
    on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__{a}") for c, a in pairs.items()))
    return df.join(sets, on).drop(*(f"__{a}" for a in pairs.values()))


def padded_lookup(df: DataFrame, side: DataFrame, code: str, side_code: str, values: Sequence[str], pad: int = 5) -> DataFrame:
    """Values of the side by code, or else by the code padded with zeros on the right."""
    one = side.select(F.col(side_code).alias("__a"), F.struct(*values).alias("__x"))
    two = side.select(F.col(side_code).alias("__b"), F.struct(*values).alias("__y"))
    out = df.join(one, F.col(code) == F.col("__a"), "left").join(two, F.rpad(F.col(code), pad, "0") == F.col("__b"), "left")
    return out.select(*df.columns, *(F.coalesce(F.col("__x"), F.col("__y"))[v].alias(v) for v in values))


def fallback_join(df: DataFrame, side: DataFrame, keys: Sequence[tuple[Column, str]], values: Sequence[str]) -> DataFrame:
    """Values of the side by the first of several (expression, side column) keys that finds a row."""
    found = []
    for i, (expr, name) in enumerate(keys):
        one = side.filter(F.col(name).isNotNull()).select(F.col(name).alias(f"__k{i}"), F.struct(*values).alias(f"__v{i}"))
        df, found = df.join(one, expr == F.col(f"__k{i}"), "left"), [*found, F.col(f"__v{i}")]
    keep = [c for c in df.columns if not c.startswith(("__k", "__v"))]
    return df.select(*keep, *(F.coalesce(*found)[v].alias(v) for v in values))


def dual_keyed(df: DataFrame, code: str) -> DataFrame:
    """Each row under its code and the code's first four characters."""
    return df.withColumn("key", F.explode(F.array_distinct(F.array(F.left(F.col(code), F.lit(4)), F.col(code)))))


def complete_inner(df: DataFrame, side: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join that fails if a row of df finds nothing."""
    if not df.join(side, list(key), "left_anti").isEmpty():
        raise ValueError(f"rows without a match on {list(key)}")
    return df.join(side, list(key))


def full_calendar(panel: DataFrame, date: str, code: str, codes: int | None = None) -> DataFrame:
    """Rows of the dates on which all codes are present."""
    codes = codes or panel.select(F.countDistinct(code)).first()[0]
    whole = panel.groupBy(date).agg(F.countDistinct(code).alias("__n")).filter(F.col("__n") == codes)
    return panel.join(whole.select(date), date, "left_semi")


#: Steps of a recursive query; one that needs more fails.
MOST_LEVELS = 1000


def recursive(rows: DataFrame, query: str) -> DataFrame:
    """A recursive query over {rows}, in at most {levels} steps. The session's limit on its rows is lifted: no step's rows are dropped, and large results don't fail."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(query.replace("{levels}", str(MOST_LEVELS)), rows=rows)


def descendants(links: DataFrame, parent: str, child: str) -> DataFrame:
    """(root, node, depth): all that is below each parent, by the links between them; a node that is reached by several ways comes once for each depth. A cycle is an error."""
    rows = links.select(F.col(parent).alias("parent"), F.col(child).alias("child")).filter("parent IS NOT NULL AND child IS NOT NULL").distinct()
    found = recursive(
        rows,
        """WITH RECURSIVE below(root, node, path, depth) MAX RECURSION LEVEL {levels} AS (
            SELECT parent, IF(parent = child, raise_error('a cycle of links'), child), array(parent, child), 1 FROM {rows}
            UNION ALL
            SELECT b.root, IF(array_contains(b.path, l.child), raise_error('a cycle of links'), l.child), array_append(b.path, l.child), b.depth + 1 FROM below b JOIN {rows} l ON b.node = l.parent
        ) SELECT root, node, depth FROM below""",
    )
    return found.distinct()


#: Buckets of keys whose digests are compared.
DIGEST_BUCKETS = 1 << 14


def _bucket(key: Sequence[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def digests(df: DataFrame, key: Sequence[str], columns: Sequence[str], buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(bucket, n, a, b): for each bucket of keys the number of rows and two sums of 64-bit row hashes.

    The sums don't depend on the rows' order and count repeats, nulls are told apart from absent values, and two buckets of different rows
    agree by chance once in 2^128. Combined in the map tasks: what shuffles are at most `buckets` rows of each.
    """
    return df.groupBy(_bucket([F.col(c) for c in key], buckets).alias("bucket")).agg(*row_sums(columns))


def row_sums(columns: Sequence[str]) -> list[Column]:
    """Aggregates n, a and b that are the same for the same rows in any order."""
    whole = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    part = lambda seed: F.sum(F.xxhash64(*whole, F.lit(seed)).cast("decimal(20,0)"))
    return [F.count("*").alias("n"), part(1).alias("a"), part(2).alias("b")]


def changed_buckets(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str], buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """(bucket) of the buckets whose rows aren't the same on both sides: at most `buckets` rows."""
    value = F.struct("n", "a", "b")
    x, y = (digests(df, key, columns, buckets).select("bucket", value.alias(n)) for df, n in ((old, "x"), (new, "y")))
    return x.join(y, "bucket", "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select("bucket")


def of_buckets(df: DataFrame, key: Sequence[str], wanted: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """The rows in some of the buckets; these, one number each, go to every task."""
    bucketed = df.withColumn("__bucket", _bucket([F.col(c) for c in key], buckets))
    return bucketed.join(F.broadcast(wanted.select(F.col("bucket").alias("__bucket"))), "__bucket", "left_semi").drop("__bucket")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """key, status (added, removed, modified), and one row for each changed field with both values as text.

    Equality is null-safe; keys that are the same in both give no row. Both tables are read for digests by bucket of keys, and again for
    the buckets that differ; only rows of these are joined.
    """
    text = lambda df: df.select(F.col(key), *(F.col(f).cast("string").alias(f) for f in fields if f != key))
    a, b = text(old), text(new)
    changed = changed_buckets(a, b, [key], a.columns, buckets)
    side = lambda df, n: of_buckets(df, [key], changed, buckets).select(F.col(key), F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(n))
    both = side(a, "o").join(side(b, "n"), key, "full")
    changes = F.array(*(F.struct(F.lit(f).alias("field"), F.col("o")[f].alias("old"), F.col("n")[f].alias("new")) for f in fields))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("modified")
    out = both.select(key, status.alias("status"), F.filter(changes, lambda x: ~x["old"].eqNullSafe(x["new"])).alias("c"))
    rows = out.filter((F.size("c") > 0) | (F.col("status") != "modified"))
    return rows.select(key, "status", F.explode_outer("c").alias("c")).select(key, "status", "c.field", "c.old", "c.new")


def unchanged(old: DataFrame, new: DataFrame, buckets: int = DIGEST_BUCKETS) -> bool:
    """Whether both have the same rows, each as often: one pass over each, by digests; columns are taken by their place."""
    new = new.toDF(*old.columns)
    if [f.dataType for f in old.schema] != [f.dataType for f in new.schema]:
        raise ValueError("columns of different types")
    return changed_buckets(old, new, old.columns, old.columns, buckets).isEmpty()


def row_changes(old: DataFrame, new: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """Rows that one side has more often than the other: all columns, `side` (old or new) and by how many, n. Only buckets that differ shuffle."""
    new = new.toDF(*old.columns)
    changed = changed_buckets(old, new, old.columns, old.columns, buckets)
    signed = of_buckets(old, old.columns, changed, buckets).withColumn("__n", F.lit(-1)).unionByName(of_buckets(new, old.columns, changed, buckets).withColumn("__n", F.lit(1)))
    more = signed.groupBy(*old.columns).agg(F.sum("__n").alias("n")).filter("n <> 0")
    return more.withColumn("side", F.when(F.col("n") < 0, "old").otherwise("new")).withColumn("n", F.abs("n"))


def classify(df: DataFrame, reasons: Sequence[tuple[str, Column]], otherwise: str, name: str = "reason") -> DataFrame:
    """The first reason whose condition holds."""
    out = F.lit(otherwise)
    for says, when in reversed(reasons):
        out = F.when(when, says).otherwise(out)
    return df.withColumn(name, out)


def text_search(df: DataFrame, q: str, exact: Sequence[str], folded: Sequence[str]) -> DataFrame:
    """Rows of which a column of `exact` contains q, or one of `folded` without regard to case. An empty q keeps all."""
    if not q:
        return df
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).contains(q) for c in exact] + [F.lower(c).contains(q.lower()) for c in folded]))


def equal_filters(df: DataFrame, **wanted) -> DataFrame:
    """Rows that have each given value; None is no filter."""
    for c, v in wanted.items():
        df = df if v is None else df.filter(F.col(c) == v)
    return df


def compile_conditions(conditions: Sequence[tuple[str, str, float]]) -> Column:
    """(metric, gte/lte/gt/lt/eq, value) triples, all of which must hold."""
    ops = {"gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "eq": lambda c, v: c == v}
    return reduce(lambda a, b: a & b, (ops[op](F.col(m), v) for m, op, v in conditions), F.lit(True))


def live_books(df: DataFrame, least_liquidity: float = 0.0) -> DataFrame:
    ok = (F.coalesce("liquidity", F.lit(0.0)) >= least_liquidity) & F.col("bid").between(0, 1) & F.col("ask").between(0, 1) & (F.col("bid") <= F.col("ask"))
    return df.filter(ok)


def event_query(df: DataFrame, ordinal: str, low=None, high=None, time: str = "observed", url: str = "url", code: str = "code", **equal) -> DataFrame:
    """Events of optional equalities and a closed time range, first of each (url, code), without empty urls, in order."""
    df = equal_filters(df, **equal).filter(F.coalesce(F.col(url), F.lit("")) != "")
    df = df if low is None else df.filter(F.col(time) >= low)
    df = df if high is None else df.filter(F.col(time) <= high)
    return first_wins(df, [url, code], ordinal).orderBy(time, code, url)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 50) -> DataFrame:
    """One page in a total order: the k-th smallest rows, which Spark takes without a full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(n: int, size: int = 50) -> int:
    return -(-n // size)


def latest_date_rows(df: DataFrame, date: str) -> DataFrame:
    """Rows of the largest date, by a scalar subquery."""
    return df.filter(F.col(date) == df.select(F.max(date)).scalar())


def crosstab(df: DataFrame, key: str, kind: str, kinds: Sequence[str], total: str | None = "total") -> DataFrame:
    """Counts of each kind by key, 0 where there are none; other kinds fail."""
    out = df.groupBy(key).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds), F.count("*").alias("__all"))
    known = reduce(lambda a, b: a + b, (F.col(k) for k in kinds))
    out = out.withColumn("__all", F.when(known == F.col("__all"), F.col("__all")).otherwise(F.raise_error(F.lit(f"unknown {kind}")).cast("long")))
    return out.withColumnRenamed("__all", total) if total else out.filter("__all >= 0").drop("__all")


def pivot_matrix(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Wide table with 0 for what is missing; the columns are named, so no pass looks for them."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.first(value)).na.fill(0)


def decision_counts(df: DataFrame, category: str, decision: str, decisions: Sequence[str]) -> DataFrame:
    """Dense counts of the decisions by category, and in all (category null, level 1)."""
    return df.rollup(category).agg(*(F.count_if(F.col(decision) == d).alias(d.lower()) for d in decisions), F.grouping(category).cast("int").alias("level"))


def dense_counts(df: DataFrame, status: str, values: Sequence[str]) -> DataFrame:
    """A count for each value, 0 where there is none."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{status} string")
    return wanted.join(df.groupBy(status).agg(F.count("*").alias("n")), status, "left").na.fill(0, ["n"])


def peak(df: DataFrame, value: str, date: str) -> DataFrame:
    """The row of the largest value; the earliest of equals."""
    return df.orderBy(F.col(value).desc(), F.col(date).asc()).limit(1)


def dominant(df: DataFrame, reason: str) -> DataFrame:
    """Counts by reason, with the most frequent one (the first by name of equals)."""
    n = df.groupBy(reason).agg(F.count("*").alias("n"))
    return n.withColumn("dominant", n.select(F.min_by(reason, F.struct(-F.col("n"), F.col(reason)))).scalar())


def unpivot_facts(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row for each key and metric that has a value; nothing is filled in or derived."""
    return df.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric_id", "value").filter("value IS NOT NULL")


def entity_match(docs: DataFrame, aliases: DataFrame, key: Sequence[str], names: str, alias: str, code: str) -> DataFrame:
    """Distinct (key, code): `names` holds ';'-separated names with '#offset' tails; equal alias keys match."""
    left = docs.select(*key, F.explode(F.split(names, ";")).alias("__n")).select(*key, S.alias_key(F.regexp_replace("__n", "#.*$", "")).alias("__k")).filter("__k IS NOT NULL")
    right = aliases.select(code, S.alias_key(F.col(alias)).alias("__k")).filter("__k IS NOT NULL")
    return left.join(right, "__k").drop("__k").distinct()


def batches(df: DataFrame, order: str, size: int = 40) -> DataFrame:
    """Batch numbers for keyed fetches: rows are few, those of one run."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], ordinal: str | None = None) -> DataFrame:
    """The rows of new, and those of old whose key it lacks. Of repeated keys of new the row of the largest ordinal stays, or without one the last in the frame's order."""
    last = last_wins(new.withColumn("__at", F.monotonically_increasing_id() if ordinal is None else F.col(ordinal)), key, "__at").drop("__at")
    return old.join(new.select(*key), list(key), "left_anti").unionByName(last)


def set_algebra(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    return {"union": a.union(b).distinct(), "intersection": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a)}


def map_ids(df: DataFrame, ids: str, lookup: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """An array of ids as the sorted distinct values that a lookup has for them."""
    name = "__row"
    numbered = df.withColumn(name, F.xxhash64(*df.columns))
    pairs = numbered.select(name, F.explode(ids).alias(key)).join(lookup.select(key, value), key)
    found = pairs.groupBy(name).agg(F.array_sort(F.collect_set(value)).alias(out))
    return numbered.join(found, name, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>"))).drop(name)


def select_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows in a closed range; an empty result is an error."""
    out = df.filter(F.col(column).between(low, high))
    if out.isEmpty():
        raise ValueError(f"no rows with {column} in {low}..{high}")
    return out


def distinct_matches(df: DataFrame, text: str, pattern: str, group: int = 1) -> DataFrame:
    """How many different texts a pattern's group matches anywhere: (n)."""
    found = df.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))).alias("m"))
    return found.agg(F.countDistinct("m").alias("n"))


def named_codes(df: DataFrame, code: str, name: str, ordinal: str) -> DataFrame:
    """Each code once with the name of its first row, by name."""
    return df.groupBy(code).agg(F.min_by(name, ordinal).alias(name)).orderBy(name, code)


def sample_per_group(df: DataFrame, group: str, order: str, found: str) -> DataFrame:
    """The first row of each group; `coverage` is the share of such rows for which `found` holds."""
    one = keep_row(df, [group], [F.col(order).asc()])
    return one.withColumn("coverage", one.select(F.avg(F.col(found).cast("double"))).scalar())


def mapped_mean(values: DataFrame, mapping: DataFrame, key: str, target: str, value: str) -> DataFrame:
    """For each target the mean value of the keys that a mapping gives it: (target, value)."""
    return values.join(small(mapping), key).groupBy(target).agg(F.avg(value).alias(value))


def evidence_ref(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """JSON of those of the columns that are there and have a value."""
    return df.withColumn("evidence", F.to_json(F.struct(*[c for c in columns if c in df.columns]), {"ignoreNullFields": "true"}))


def regime_signals(values: DataFrame, key: str, time: str, value: str, pc1: str, direction: str, window: int = 5) -> DataFrame:
    """Mean of the last rows (up to `window`), turned in extreme regimes, squashed and classified: the signal for the next row of each key."""
    w = Window.partitionBy(key).orderBy(time).rowsBetween(1 - window, 0)
    raw = F.avg(value).over(w) * S.regime_direction(F.col(pc1), F.col(direction))
    out = values.withColumn("__s", S.squash(raw))
    after = Window.partitionBy(key).orderBy(time)
    return out.withColumn("signal", F.lag("__s").over(after)).drop("__s")


def keyword_or_member(kind: Column, kinds: Sequence, text: Column, term: str) -> Column:
    """Whether a value is one of the kinds, or a text contains the term; null is neither."""
    return F.coalesce(kind.isin(list(kinds)), F.lit(False)) | F.coalesce(F.contains(text, F.lit(term)), F.lit(False))


def search_page(df: DataFrame | TextIndex, q: str, exact: Sequence[str], folded: Sequence[str], order: Sequence[Column], most: int = 100) -> DataFrame:
    """The first `most` rows that a search finds, in a total order; an empty q gives the first page of all. Over a TextIndex only the blocks that can match are read."""
    found = text_search(df, q, exact, folded) if isinstance(df, DataFrame) else df.search(q, exact, folded)
    return found.orderBy(*order).limit(most)


def plot_window(df: DataFrame, year: str, last: int, value: str) -> DataFrame:
    """Rows up to a year with a value, by year."""
    return df.filter((F.col(year) <= last) & F.col(value).isNotNull()).orderBy(year)


def table_stats(df: DataFrame, group: Sequence[str], date: str) -> DataFrame:
    """Rows, first and last date of each group; nothing is taken to be sorted."""
    return df.groupBy(*group).agg(F.count("*").alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def distinct_in_order(c: str | Column) -> Column:
    """An array without repeats, each value where it stood first."""
    return F.array_distinct(c)


def locale_order(df: DataFrame, column: str, *ties: str, collation: str = "UNICODE") -> DataFrame:
    """Rows in a locale's order of a text column, instead of that of code points."""
    return df.orderBy(F.collate(column, collation), *ties)
