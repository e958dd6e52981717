"""Preparing a panel for a model: which assets, which features, which dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from . import quality
from . import relational as R
from . import timeseries as TS

#: Rows of the rolling features, and the trading days that an asset needs at most.
WINDOWS, MOST_DAYS = (5, 20, 60), 60


def choose_universe(prices: DataFrame, cutoff, most: int, date: str = "Date", code: str = "Code", close: str = "Close", volume: str = "Volume") -> DataFrame:
    """(code, days, adv): the `most` assets of the largest mean dollar volume up to the cutoff, of those with at least min(60, the largest number of) days; ties by days, then code.

    No rows up to the cutoff, or fewer than two assets, are errors. One aggregate over the rows, and a top-n.
    """
    if most < 2:
        raise ValueError("a universe has two assets at least")
    stats = prices.filter(F.col(date) <= F.lit(cutoff)).groupBy(code).agg(F.countDistinct(date).alias("days"), F.avg(F.col(close) * F.col(volume)).alias("adv"))
    least = F.least(F.lit(MOST_DAYS), stats.select(F.max("days")).scalar())
    chosen = stats.filter(F.col("days") >= least).orderBy(F.desc("adv"), F.desc("days"), code).limit(most)
    if chosen.limit(2).count() < 2:
        raise quality.QualityError("fewer than two assets up to the cutoff")
    return chosen


def asset_features(prices: DataFrame, windows: Sequence[int] = WINDOWS, date: str = "Date", code: str = "Code", close: str = "Close", volume: str = "Volume", parts: int | None = None) -> DataFrame:
    """(date, code, asset_return, features): log return, log volume, and for each window means and population deviations of both and momentum.

    A window counts only if it is full of values; infinite values are null. All columns come from two passes over one window of each asset (parts: see timeseries).
    """
    base = prices.select(date, code, F.ln(F.nullif(F.col(close), F.lit(0.0))).alias("__p"), F.log1p(volume).alias("log_volume"))
    base = TS.over(base, [code], date, lambda w: {"log_return": F.col("__p") - F.lag("__p").over(w)}, before=1, parts=parts)

    def columns(w: WindowSpec) -> dict:
        out = {}
        for n in windows:
            frame = w.rowsBetween(1 - n, 0)
            full = lambda c, f: F.when(F.count(c).over(frame) == n, f(c).over(frame))  # noqa: B023, E731
            out |= {f"ret_mean_{n}": full("log_return", F.avg), f"ret_std_{n}": full("log_return", F.stddev_pop), f"momentum_{n}": F.col("__p") - F.lag("__p", n).over(w), f"vol_mean_{n}": full("log_volume", F.avg), f"vol_std_{n}": full("log_volume", F.stddev_pop)}
        return out

    found = TS.over(base, [code], date, columns, before=max(windows), parts=parts)
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    names = [c for c in found.columns if c not in (date, code, "__p")]
    return found.select(date, code, finite("log_return").alias("asset_return"), *(finite(c).alias(c) for c in names))


def prepared_panel(prices: DataFrame, benchmark: DataFrame, cutoff, most: int, start=None, end=None, windows: Sequence[int] = WINDOWS, least_dates: int = 252, date: str = "Date", code: str = "Code", value: str = "benchmark", parts: int | None = None) -> DataFrame:
    """The chosen assets' features as z-scores of each date, their returns and the benchmark's, on the dates that have all of them.

    benchmark: (date, value). A date stays if every chosen asset has a row with a return and the benchmark has a value there: the benchmark is put on the
    panel's calendar and its gaps cut that, so that both end on the same dates. Fewer than `least_dates` are an error. The chosen assets and the
    dates are small sides of joins, checked as such.
    """
    codes = R.small(choose_universe(prices, cutoff, most, date, code).select(code))
    n = codes.count()
    panel = asset_features(prices.join(codes, code, "left_semi"), windows, date, code, parts=parts)
    for bound, keep in ((start, lambda: F.col(date) >= F.lit(start)), (end, lambda: F.col(date) <= F.lit(end))):
        panel = panel if bound is None else panel.filter(keep())
    features = [c for c in panel.columns if c not in (date, code, "asset_return")]
    scored = TS.cross_section_zscore(panel, date, features).select(date, code, "asset_return", *(F.col(f"z_{c}").alias(c) for c in features))
    whole = scored.groupBy(date).agg(F.countDistinct(code).alias("__n"), F.countDistinct(F.when(F.col("asset_return").isNotNull(), F.col(code))).alias("__k")).filter(f"__n = {n} AND __k = {n}")
    dates = whole.join(benchmark.select(date, value).filter(F.col(value).isNotNull()), date).select(date, value)
    if (have := dates.count()) < least_dates:
        raise quality.QualityError(f"{have} dates have all assets and a benchmark; {least_dates} are needed")
    return scored.filter("asset_return IS NOT NULL").join(R.small(dates), date)
