"""Statistics of return series and classifiers."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import try_ratio
from .relational import keep_row
from .scan import whole
from .timeseries import max_drawdown, ordered, over


def sharpe(ret: str, periods: int = 252, sample: bool = True) -> Column:
    """sqrt(periods) * mean / deviation; 0 for fewer than two rows or no spread."""
    sd = F.stddev_samp(ret) if sample else F.stddev_pop(ret)
    ok = (F.count(ret) >= (2 if sample else 1)) & (sd > 1e-12)
    return F.when(ok, math.sqrt(periods) * F.avg(ret) / F.nullif(sd, F.lit(0.0))).otherwise(0.0)


def factor_metrics(df: DataFrame, key: Sequence[str], time: str, ret: str, periods: int = 12) -> DataFrame:
    """Months, annual mean, volatility, Sharpe, cumulative return, CAGR, hit rate, iid t and maximum drawdown of each key. No spread gives null."""
    n, mean, sd = F.count(ret), F.avg(ret), F.stddev_samp(ret)
    grown = F.exp(F.sum(F.log1p(ret)))
    out = df.groupBy(*key).agg(
        n.alias("n"), (periods * mean).alias("mean"), (math.sqrt(periods) * sd).alias("vol"), try_ratio(periods * mean, math.sqrt(periods) * sd).alias("sharpe"),
        (grown - 1).alias("cumulative"), (F.pow(grown, periods / n) - 1).alias("cagr"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"), try_ratio(mean, sd / F.sqrt(n)).alias("t_iid"),
    )
    worst = max_drawdown(df, key, time, ret)
    return out.join(worst, list(key)) if key else out.withColumn("max_drawdown", worst.scalar())


def newey_west(df: DataFrame, key: Sequence[str], time: str, ret: str, lags: int = 6, strict: bool = False, parts: int | None = None) -> DataFrame:
    """t value of the mean with Bartlett weights over min(lags, n - 1) autocovariances; if the variance isn't positive null, or with `strict` an error."""
    c = whole(df, key, __m=F.avg(ret), __n=F.count(ret)).withColumn("__c", F.col(ret) - F.col("__m"))
    used = F.least(F.lit(lags), F.col("__n") - 1)
    c = over(c, key, time, lambda w: {f"__c{k}": F.col("__c") * F.lag("__c", k).over(w) for k in range(1, lags + 1)}, before=lags, parts=parts)
    weight = [F.greatest(F.lit(0.0), 1 - F.lit(k) / (used + 1)) for k in range(1, lags + 1)]
    variance = F.sum(F.col("__c") * F.col("__c")) + 2 * sum((F.coalesce(F.sum(w * F.col(f"__c{k}")), F.lit(0.0)) for k, w in enumerate(weight, 1)), F.lit(0.0))
    out = c.groupBy(*key).agg(F.avg(ret).alias("mean"), F.count(ret).alias("n"), variance.alias("v"))
    bad = F.raise_error(F.lit("long-run variance is not positive")).cast("double") if strict else F.lit(None).cast("double")
    return out.select(*key, "n", "mean", F.when(F.col("v") > 0, F.col("mean") / F.sqrt(F.col("v") / F.col("n") / F.col("n"))).otherwise(bad).alias("t_nw"))


def moving_block_ci(df: DataFrame, time: str, ret: str, block: int = 12, reps: int = 20_000, seed: int = 2306, periods: int = 12) -> DataFrame:
    """95 % interval of the annual mean by moving blocks: (low, high).

    One random stream makes the resamples, so that figures can be told again: one series (of months) goes to one task.
    """

    def run(key, pdf):
        x = pdf.sort_values(time)[ret].tolist()
        n, rng, size = len(x), random.Random(seed), block
        if n < size:
            raise ValueError(f"{n} rows are fewer than a block of {size}")
        prefix = [0.0]
        for v in x:
            prefix.append(prefix[-1] + v)
        starts, means = range(n - size + 1), []
        for _ in range(reps):
            total, left = 0.0, n
            while left > 0:
                s = rng.choice(starts)
                take = min(size, left)
                total += prefix[s + take] - prefix[s]
                left -= take
            means.append(periods * total / n)
        means.sort()
        return pd.DataFrame({"low": [means[int(0.025 * reps)]], "high": [means[max(0, int(0.975 * reps) - 1)]]})

    return df.select(time, ret, F.lit(1).alias("__k")).groupBy("__k").applyInPandas(run, "low double, high double")


def cost_grid(df: DataFrame, ret: str, bps: Sequence[int] = (0, 10, 25, 50)) -> DataFrame:
    """Each row once for every cost, with the return less it; the grid is a literal, exploded."""
    return df.withColumn("cost_bps", F.explode(F.array(*map(F.lit, bps)))).withColumn("net", F.col(ret) - F.col("cost_bps") / 10_000)


def gate(t_nw: Column, ci_low: Column, late_mean: Column, net_mean: Column, least_t: float = 1.96) -> Column:
    ok = (t_nw >= least_t) & (ci_low > 0) & (late_mean > 0) & (net_mean > 0)
    return F.when(F.coalesce(ok, F.lit(False)), "confirmed").otherwise("not_confirmed")


def safe_corr(x: str, y: str) -> Column:
    """Pearson's correlation; 0 for fewer than two rows or where either has no spread."""
    ok = (F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()) >= 2) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12)
    return F.when(ok, try_ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).otherwise(0.0)


def revision_stats(old: DataFrame, new: DataFrame, month: str, value: str) -> DataFrame:
    """Over the months in both: how many changed by more than 1e-12, and the changes in basis points."""
    both = old.select(month, F.col(value).alias("a")).join(new.select(month, F.col(value).alias("b")), month)
    d = (F.col("b") - F.col("a")) * 10_000
    changed = F.abs(F.col("b") - F.col("a")) > 1e-12
    return both.agg(F.count("*").alias("months"), F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count_if(changed).alias("changed"), F.avg(changed.cast("double")).alias("share_changed"), F.avg(d).alias("mean_bps"), F.avg(F.abs(d)).alias("mean_abs_bps"), F.max(F.abs(d)).alias("max_abs_bps"))


def reconstruction(df: DataFrame, size: Sequence[str], style: Sequence[str]) -> DataFrame:
    """Size and style factors of six portfolios given as (small low, small mid, small high, big low, big mid, big high)."""
    s, b = [F.col(c) for c in size[:3]], [F.col(c) for c in size[3:]]
    return df.withColumns({style[0]: sum(s[1:], s[0]) / 3 - sum(b[1:], b[0]) / 3, style[1]: (s[2] + b[2]) / 2 - (s[0] + b[0]) / 2})


def confusion(df: DataFrame, truth: str, predicted: str, key: Sequence[str] = ()) -> DataFrame:
    """Counts, rates over all rows, and accuracy, precision, recall, F1 (0 where undefined) and MCC of 0/1 columns."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.groupBy(*key).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    n = F.expr("cast(tp + fp + fn + tn as double)")
    z = lambda a, b: F.coalesce(try_ratio(a, b), F.lit(0.0))
    col = lambda e: F.expr(f"cast({e} as double)")
    c = c.withColumns({"tp_rate": z(col("tp"), n), "tn_rate": z(col("tn"), n), "fp_rate": z(col("fp"), n), "fn_rate": z(col("fn"), n), "accuracy": z(col("tp + tn"), n), "precision": z(col("tp"), col("tp + fp")), "recall": z(col("tp"), col("tp + fn"))})
    c = c.withColumn("f1", z(col("2 * tp"), col("2 * tp + fp + fn")))
    return c.withColumn("mcc", z(col("tp * tn - fp * fn"), F.sqrt(col("tp + fp") * col("tp + fn") * col("tn + fp") * col("tn + fn"))))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve with average ranks of ties.

    Scores are first counted by value; values are summed up in 256 ranges between approximate quantiles, and ranks are exact: each range
    is ordered by itself and begins at the sum of those before it.
    """
    v = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count("*").alias("n"))
    edges = v.agg(F.percentile_approx("s", [k / 256 for k in range(1, 256)], 10_000)).scalar()
    v = v.withColumn("__e", edges).withColumn("b", F.size(F.filter("__e", lambda e: e < F.col("s")))).drop("__e")
    before = F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    begins = v.groupBy("b").agg(F.sum("n").alias("m")).select("b", F.coalesce(before, F.lit(0)).alias("begin"))
    within = F.sum("n").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    r = v.withColumn("w", within).join(F.broadcast(begins), "b").withColumn("rank", F.col("begin") + F.col("w") - (F.col("n") - 1) / 2)
    a = r.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("np"), F.sum(F.col("n") - F.col("p")).cast("double").alias("nn"))
    return a.select(try_ratio(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn")).alias("auc"))


def majority_baseline(df: DataFrame, truth: str) -> Column:
    """1 if more than half of the labels are; ties give 0."""
    return df.select((F.count_if(F.col(truth) == 1) > F.count(truth) / 2).cast("int")).scalar()


def bootstrap_ci(df: DataFrame, value: str, reps: int = 2000, seed: int = 7) -> DataFrame:
    """95 % interval of the mean: Poisson(1) weights instead of draws, so resamples add up in the map tasks: a task hands on one row of sums for each resample.

    The weight of a row in a resample follows from a hash of the row's value, its number among equal values and the resample: the same however the rows are dealt to tasks.
    """
    import numpy as np

    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def run(batches):
        total = np.zeros((2, reps))
        for pdf in batches:
            for low in range(0, len(pdf), 500):
                x, h = pdf["x"].to_numpy()[low : low + 500], pdf["h"].to_numpy()[low : low + 500].view(np.uint64)
                h = h[:, None] + np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(steps, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, "right").astype(float)
                total += w.sum(0), x @ w
        yield pd.DataFrame({"rep": np.arange(reps), "w": total[0], "x": total[1]})

    r = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    sums = r.select("x", F.xxhash64("x", "i", F.lit(seed)).alias("h")).mapInPandas(run, "rep int, w double, x double").groupBy("rep").agg(F.sum("w").alias("w"), F.sum("x").alias("x"))
    return sums.select(try_ratio(F.col("x"), F.col("w")).alias("m")).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def permutation_p(hits: Column, reps: int) -> Column:
    return (hits + 1) / (reps + 1)


def significance(df: DataFrame, truth: str, predicted: str, reps: int = 2000, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """(metric, value, low, high, p_value) of 0/1 columns: 95 % intervals of accuracy, precision, recall, F1 (0 where undefined) and MCC by resampled rows, and of accuracy the share of permuted predictions that reach it.

    All metrics follow from the four counts. Drawing rows anew draws the counts from a multinomial distribution, and permuting the predictions draws the hits from a
    hypergeometric one: both exact, so that only four counts come to the driver, whatever the rows.
    """
    import numpy as np

    c = confusion(df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()), truth, predicted).select("tp", "fp", "fn", "tn").first()
    counts, rng = np.array(c, np.int64), np.random.default_rng(seed)
    n = int(counts.sum())

    def metrics(x):
        tp, fp, fn, tn = (x[:, i].astype(float) for i in range(4))
        ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
        mcc = ratio(tp * tn - fp * fn, np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
        return {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "mcc": mcc}

    point, drawn = metrics(counts[None]), metrics(rng.multinomial(n, counts / max(1, n), reps) if n else np.zeros((reps, 4), np.int64))
    tp, fp, fn, tn = (int(x) for x in counts)
    both = rng.hypergeometric(tp + fn, fp + tn, tp + fp, permutations) if n else np.zeros(permutations, np.int64)
    hits = int((2 * both + n - (tp + fn) - (tp + fp) >= tp + tn).sum())
    rows = [(k, float(point[k][0]), *(float(x) for x in np.percentile(drawn[k], [2.5, 97.5])), (hits + 1) / (permutations + 1) if k == "accuracy" else None) for k in point]
    return df.sparkSession.createDataFrame(rows, "metric string, value double, low double, high double, p_value double")


def strategy_stats(df: DataFrame, key: Sequence[str], ret: str) -> DataFrame:
    """Mean, population volatility, Sharpe and win rate by key."""
    return df.groupBy(*key).agg(F.avg(ret).alias("mean"), F.stddev_pop(ret).alias("vol"), sharpe(ret, sample=False).alias("sharpe"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"))


def fundamentals(df: DataFrame, key: Sequence[str], year: str = "year") -> DataFrame:
    """CAGR of revenue and net income, mean ROE, first and latest margin and free cash flow of annual rows (revenue, net_income, operating_income, roe, cf_operating, cf_investing).

    The periods of a CAGR are the rows less one; it is null where an end isn't positive.
    """
    first, last, years = (lambda c: F.min_by(c, year)), (lambda c: F.max_by(c, year)), F.count("*") - 1
    cagr = lambda c: F.when((first(c) > 0) & (last(c) > 0) & (years > 0), F.pow(last(c) / first(c), 1 / F.nullif(years, F.lit(0))) - 1)
    return df.groupBy(*key).agg(
        cagr("revenue").alias("revenue_cagr"), cagr("net_income").alias("net_income_cagr"), F.avg("roe").alias("mean_roe"), try_ratio(first("operating_income"), first("revenue")).alias("first_margin"),
        try_ratio(last("operating_income"), last("revenue")).alias("operating_margin"), last(F.col("cf_operating") + F.col("cf_investing")).alias("free_cash_flow"),
    )


def reconstruction_audit(df: DataFrame, month: str, factors: dict[str, tuple[str, str]], most_bps: float = 3.0) -> DataFrame:
    """For each factor (name -> rebuilt and official column): months in both, first and last, largest and mean absolute difference in basis points, and whether the largest is within `most_bps`. One pass."""
    rows = F.array(*(F.struct(F.lit(n).alias("factor"), ((F.col(a) - F.col(b)) * 10_000).alias("d")) for n, (a, b) in factors.items()))
    d = df.select(month, F.explode(rows).alias("x")).select(month, "x.*").filter("d IS NOT NULL")
    out = d.groupBy("factor").agg(F.count("*").alias("months"), F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.max(F.abs("d")).alias("max_abs_bps"), F.avg(F.abs("d")).alias("mean_abs_bps"))
    return out.withColumn("within", F.col("max_abs_bps") <= most_bps + 1e-12)


def verdict_stability(df: DataFrame, key: Sequence[str], verdict: str) -> DataFrame:
    """Runs of each key, its verdicts with their numbers, and whether all runs agree."""
    n = df.groupBy(*key, verdict).agg(F.count("*").alias("__n"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(verdict), F.col("__n")))))
    return n.groupBy(*key).agg(F.sum("__n").alias("runs"), counts.alias("verdict_counts"), (F.count("*") == 1).alias("verdict_stable"))


def best_restart(df: DataFrame, key: Sequence[str], objective: str, ident: str) -> DataFrame:
    """The row of the largest objective of each key, the first by ident of equals."""
    return keep_row(df, key, [F.col(objective).desc_nulls_last(), F.col(ident).asc()])


def merged_moments(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """n, mean and variance of each key from sums of values and squares, which chunks can add up in any order; a variance below 0 by rounding is 0. Values that aren't finite are an error."""
    x = F.when(F.abs(value) < float("inf"), F.col(value)).when(F.col(value).isNotNull(), F.raise_error(F.lit("a value that is not finite")).cast("double"))
    sums = df.groupBy(*key).agg(F.count(value).alias("n"), F.sum(x).alias("__s"), F.sum(x * x).alias("__q"))
    mean = try_ratio(F.col("__s"), F.col("n"))
    return sums.select(*key, "n", mean.alias("mean"), F.greatest(F.lit(0.0), try_ratio(F.col("__q"), F.col("n")) - mean * mean).alias("variance"))
