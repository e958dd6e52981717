"""Time series by key: every function takes (frame, key columns, order column) and adds columns.

With keys, the columns are windows by key. Without any (`key=[]`), or where `parts` says into how many, the series are cut into segments that are
worked on apart (`scan`), so that one long series, or a key that holds much of the rows, doesn't end in one task; the results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import try_ratio
from .scan import scan, whole, windowed


def ordered(key: Sequence[str], time: str):
    return Window.partitionBy(*key).orderBy(time)


def over(df: DataFrame, key: Sequence[str], time: str, columns: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0, parts: int | None = None) -> DataFrame:
    """df with columns(w), over frames that reach at most so many rows back and ahead."""
    if key and parts is None:
        return df.withColumns(columns(ordered(key, time)))
    return windowed(df, key, time, columns, before, after, parts)


def simple_return(df: DataFrame, key: Sequence[str], time: str, price: str, out: str = "ret", parts: int | None = None) -> DataFrame:
    """(p - p') / p' against the row before; null where either is missing or zero."""
    p = F.nullif(F.col(price), F.lit(0.0))
    return over(df, key, time, lambda w: {out: try_ratio(p - F.lag(price).over(w), F.lag(price).over(w))}, before=1, parts=parts)


def log_return(df: DataFrame, key: Sequence[str], time: str, price: str, lag: int = 1, out: str = "log_ret", parts: int | None = None) -> DataFrame:
    """ln(p / p') against the row `lag` before."""
    return over(df, key, time, lambda w: {out: F.ln(F.col(price)) - F.ln(F.lag(price, lag).over(w))}, before=lag, parts=parts)


def momentum(df: DataFrame, key: Sequence[str], time: str, price: str, window: int, out: str = "mom", parts: int | None = None) -> DataFrame:
    return log_return(df, key, time, price, window, out, parts)


def rolling(df: DataFrame, key: Sequence[str], time: str, value: str, window: int, full: bool = True, parts: int | None = None) -> DataFrame:
    """Mean and population deviation of the last `window` rows, as mean_w and std_w; with `full`, null until all of them have values."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        w = w.rowsBetween(1 - window, 0)
        ok = (F.count(value).over(w) == window) if full else F.lit(True)
        return {f"mean_{window}": F.when(ok, F.avg(value).over(w)), f"std_{window}": F.when(ok, F.stddev_pop(value).over(w))}

    return over(df, key, time, columns, before=window - 1, parts=parts)


def cross_section_zscore(df: DataFrame, date: str, values: Sequence[str]) -> DataFrame:
    """z_<value>: distance from the date's mean in population deviations; 0 where that has no value or no spread."""
    w = Window.partitionBy(date)
    return df.withColumns({f"z_{v}": F.coalesce(try_ratio(F.col(v) - F.avg(v).over(w), F.stddev_pop(v).over(w)), F.lit(0.0)) for v in values})


_SO_FAR = (Window.unboundedPreceding, 0)


def _growth(df: DataFrame, key: Sequence[str], time: str, ret: str, parts: int | None) -> DataFrame:
    """df with __log and __top: the sum of log1p(r) up to each row, and its largest value so far."""
    if key and parts is None:
        w = ordered(key, time).rowsBetween(*_SO_FAR)
        return df.withColumn("__log", F.sum(F.log1p(ret)).over(w)).withColumn("__top", F.max("__log").over(w))
    total = F.coalesce(F.sum(F.log1p(ret)), F.lit(0.0))
    none = F.lit(float("-inf"))
    return scan(
        df, key, time, local=lambda w: {"__l": F.sum(F.log1p(ret)).over(w.rowsBetween(*_SO_FAR)), "__m": F.max("__l").over(w.rowsBetween(*_SO_FAR))},
        summary={"sum": total, "top": F.coalesce(F.max("__l"), none)},
        combine=lambda a, b: {"sum": a["sum"] + b["sum"], "top": F.greatest(a["top"], a["sum"] + b["top"])},
        finish=lambda c: {"__log": F.coalesce(F.col("__l") + F.coalesce(c["sum"], F.lit(0.0)), F.when(c["top"] > none, c["sum"])), "__top": F.nullif(F.greatest(c["top"], F.col("__m") + F.coalesce(c["sum"], F.lit(0.0))), none)},
        parts=parts,
    )


def wealth(df: DataFrame, key: Sequence[str], time: str, ret: str, out: str = "wealth", parts: int | None = None) -> DataFrame:
    """Running product of 1 + r, for r > -1."""
    return _growth(df, key, time, ret, parts).withColumn(out, F.exp("__log")).drop("__log", "__top")


def drawdown(df: DataFrame, key: Sequence[str], time: str, ret: str, include_initial: bool = True, out: str = "drawdown", parts: int | None = None) -> DataFrame:
    """wealth / peak - 1, where the peak counts the initial 1.0 or not."""
    df = _growth(df, key, time, ret, parts)
    peak = F.exp("__top")
    peak = F.greatest(F.lit(1.0), peak) if include_initial else peak
    return df.withColumn(out, F.exp("__log") / peak - 1).drop("__log", "__top")


def max_drawdown(df: DataFrame, key: Sequence[str], time: str, ret: str, include_initial: bool = True, positive_percent: bool = False, parts: int | None = None) -> DataFrame:
    worst = F.min(F.least(F.col("drawdown"), F.lit(0.0)))
    return drawdown(df, key, time, ret, include_initial, parts=parts).groupBy(*key).agg((-worst * 100 if positive_percent else worst).alias("max_drawdown"))


def numbered(df: DataFrame, key: Sequence[str], time: str, out: str, parts: int | None = None) -> DataFrame:
    """df with each row's number, from 1."""
    if key and parts is None:
        return df.withColumn(out, F.row_number().over(ordered(key, time)).cast("long"))
    return scan(
        df, key, time, local=lambda w: {"__row": F.row_number().over(w).cast("long")}, summary={"n": F.count("*")},
        combine=lambda a, b: {"n": a["n"] + b["n"]}, finish=lambda c: {out: F.col("__row") + F.coalesce(c["n"], F.lit(0))}, parts=parts,
    )


def turnover(df: DataFrame, asset: Sequence[str], date: str, weight: str = "w") -> DataFrame:
    """Sum over assets of the change of weight from the row before, the first from 0: (date, turnover)."""
    step = F.abs(F.col(weight) - F.lag(weight, 1, 0.0).over(ordered(asset, date)))
    return df.withColumn("__s", step).groupBy(date).agg(F.sum("__s").alias("turnover"))


def blocks(df: DataFrame, key: Sequence[str], time: str, value: str, size: int, out: str = "realized", parts: int | None = None) -> DataFrame:
    """Sum of squares over blocks of `size` rows in order; the last may be shorter."""
    n = F.floor((F.col("__i") - 1) / size)
    return numbered(df, key, time, "__i", parts).withColumn("block", n).groupBy(*key, "block").agg(F.sum(F.col(value) * F.col(value)).alias(out))


def gaps(df: DataFrame, key: Sequence[str], year: str) -> DataFrame:
    """Rows whose year doesn't follow the one before."""
    before = F.lag(year).over(ordered(key, year))
    return df.withColumn("__b", before).filter((F.col("__b").isNotNull()) & (F.col(year) != F.col("__b") + 1)).drop("__b")


def sign_signal(df: DataFrame, key: Sequence[str], time: str, price: str, lag: int = 252, out: str = "signal", parts: int | None = None) -> DataFrame:
    return over(df, key, time, lambda w: {out: F.signum(F.col(price) - F.lag(price, lag).over(w))}, before=lag, parts=parts)


def yoy_growth(df: DataFrame, key: Sequence[str], period: str, value: str, out: str = "growth") -> DataFrame:
    """(latest - before) / |before| of the two latest periods of each key; null unless both are there and not 0."""
    w = Window.partitionBy(*key).orderBy(F.col(period).desc())
    rows = df.withColumns({"__n": F.row_number().over(w), "__p": F.lead(value).over(w)}).filter("__n = 1")
    ok = (F.col(value) != 0) & (F.col("__p") != 0)
    return rows.select(*key, F.when(ok, (F.col(value) - F.col("__p")) / F.abs("__p")).alias(out))


def midpoint(df: DataFrame, key: Sequence[str], time: str, out: str = "half", parts: int | None = None) -> DataFrame:
    """'early' for the first n // 2 rows of each key, else 'late'."""
    if key and parts is None:
        rows = df.withColumns({"__n": F.count("*").over(Window.partitionBy(*key)), "__i": F.row_number().over(ordered(key, time))})
    else:
        rows = whole(numbered(df, key, time, "__i", parts), key, __n=F.count("*"))
    return rows.withColumn(out, F.when(F.col("__i") <= F.floor(F.col("__n") / 2), "early").otherwise("late")).drop("__n", "__i")


def early_and_recent(df: DataFrame, key: Sequence[str], time: str, value: str, most: int = 7) -> DataFrame:
    """Means of the first and the last min(most, max(1, n // 2)) rows of each key."""
    up, down, whole = ordered(key, time), Window.partitionBy(*key).orderBy(F.col(time).desc()), Window.partitionBy(*key)
    n = F.count("*").over(whole)
    rows = df.withColumns({"__a": F.row_number().over(up), "__z": F.row_number().over(down), "__k": F.least(F.lit(most), F.greatest(F.lit(1), F.floor(n / 2)))})
    mean = lambda c: F.avg(F.when(F.col(c) <= F.col("__k"), F.col(value)))
    return rows.groupBy(*key).agg(mean("__a").alias("early_mean"), mean("__z").alias("recent_mean"))


def first_and_last(df: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """First and last value and the number of rows of each key."""
    return df.groupBy(*key).agg(F.min_by(value, time).alias("first_value"), F.max_by(value, time).alias("last_value"), F.count("*").alias("n"))


def share_increasing(df: DataFrame, key: Sequence[str], time: str, value: str, least: float = 0.6) -> DataFrame:
    """Share of the keys with at least two rows whose last value is above the first, and whether it reaches `least`."""
    share = F.avg((F.col("last_value") > F.col("first_value")).cast("double"))
    return first_and_last(df, key, time, value).filter("n >= 2").agg(F.count("*").alias("entities"), share.alias("share")).withColumn("holds", F.col("share") >= least)


def multiscale_window(series: Column, t: Column, steps: Sequence[int] = (1, 5, 21), samples: int = 100) -> Column:
    """For each step the values at t, t - step, ...: indexes are clipped to the series, oldest first."""
    def at_step(step: int) -> Column:
        index = lambda k: F.greatest(F.lit(0), F.least(t - k * step, F.size(series) - 1)).cast("int")
        return F.transform(F.sequence(F.lit(samples - 1), F.lit(0)), lambda k: F.get(series, index(k)))

    return F.array(*map(at_step, steps))


def next_period(df: DataFrame, key: Sequence[str], time: str, value: str, out: str = "target", parts: int | None = None) -> DataFrame:
    """The value one row later, for decisions that see only what came before; the last row of each key goes."""
    return over(df, key, time, lambda w: {out: F.lead(value).over(w), "__l": F.lead(F.lit(1)).over(w)}, after=1, parts=parts).filter("__l = 1").drop("__l")


def tumbling(df: DataFrame, time: str, width: str, key: Sequence[str], *aggregates: Column) -> DataFrame:
    out = df.groupBy(F.window(time, width), *key).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, key: Sequence[str], *aggregates: Column) -> DataFrame:
    out = df.groupBy(F.session_window(time, gap), *key).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])
