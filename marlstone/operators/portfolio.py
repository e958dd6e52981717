"""Portfolios: neutral weights, evaluation of weight paths, folds, costs, gates, trade simulation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .. import storage
from ..functions.scalars import try_ratio
from .relational import range_join
from .stats import safe_corr, sharpe
from .timeseries import max_drawdown, numbered, ordered, over


def neutral_weights(df: DataFrame, date: str, weight: str, out: str = "w") -> DataFrame:
    """Weights less the date's mean, scaled down where their gross is above 1."""
    w = Window.partitionBy(date)
    df = df.withColumn("__c", F.col(weight) - F.avg(weight).over(w))
    return df.withColumn(out, F.col("__c") / F.greatest(F.lit(1.0), F.sum(F.abs("__c")).over(w))).drop("__c")


def weight_path(df: DataFrame, asset: str, date: str, weight: str, ret: str, cost_bps: float = 15.0, short_fee: float = 0.01) -> DataFrame:
    """By date: turnover, gross, net and short exposure, gross return, and the return net of costs and the annual fee on short positions.

    Weights are made neutral first; the first turnover is against no position.
    """
    df = neutral_weights(df, date, weight, "__w")
    df = df.withColumn("__s", F.abs(F.col("__w") - F.lag("__w", 1, 0.0).over(ordered([asset], date))))
    out = df.groupBy(date).agg(F.sum("__s").alias("turnover"), F.sum(F.abs("__w")).alias("gross"), F.sum("__w").alias("net_exposure"), F.sum(F.greatest(-F.col("__w"), F.lit(0.0))).alias("short"), F.sum(F.col("__w") * F.col(ret)).alias("gross_return"))
    return out.withColumn("net_return", F.col("gross_return") - F.col("turnover") * cost_bps / 1e4 - F.col("short") * short_fee / 252)


def path_metrics(path: DataFrame, benchmark: DataFrame, date: str, market: str) -> DataFrame:
    """Observations, Sharpe, cumulative return, mean turnover and gross, largest net exposure, correlation with the benchmark, and the drawdown whose peak begins with the first equity."""
    both = path.join(benchmark, date)
    out = both.agg(F.count("*").alias("n"), sharpe("net_return").alias("sharpe"), safe_corr("net_return", market).alias("corr"), F.avg("turnover").alias("mean_turnover"), F.avg("gross").alias("mean_gross"), F.max(F.abs("net_exposure")).alias("max_net"), (F.product(1 + F.col("net_return")) - 1).alias("cumulative_return"))
    return out.withColumn("max_drawdown", max_drawdown(both, [], date, "net_return", include_initial=False).scalar())


def walk_forward_folds(spark: SparkSession, first: str, last: str, train: int = 36, validation: int = 6, test: int = 6) -> DataFrame:
    """Folds of calendar months as half-open ranges: (fold, train_start, validation_start, test_start, test_end), all within the dates."""
    months = spark.sql(f"SELECT explode(sequence(trunc(DATE'{first}', 'MM'), trunc(DATE'{last}', 'MM'), make_interval(0, {test}))) AS train_start")
    step = lambda n: F.add_months("train_start", n)
    out = months.select("train_start", step(train).alias("validation_start"), step(train + validation).alias("test_start"), step(train + validation + test).alias("test_end"))
    out = out.filter(F.col("test_end") <= F.add_months(F.trunc(F.lit(last).cast("date"), "MM"), 1))
    return out.select(F.row_number().over(Window.orderBy("train_start")).alias("fold"), "*")


def fold_dates(dates: DataFrame, date: str, folds: DataFrame) -> DataFrame:
    """Numbers of dates of each part of each fold."""
    joined = range_join(dates, folds, date, "train_start", "test_end")
    part = F.when(F.col(date) < F.col("validation_start"), "train").when(F.col(date) < F.col("test_start"), "validation").otherwise("test")
    return joined.groupBy("fold", part.alias("part")).agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def overlapping(df: DataFrame, date: str) -> DataFrame:
    """Dates in more than one fold."""
    return df.groupBy(date).agg(F.count("*").alias("n")).filter("n > 1")


def compare_gates(primary: DataFrame, ablation: DataFrame, folds: int) -> DataFrame:
    """Five gates over two one-row results of path_metrics, and the decision."""
    both = primary.select(F.struct("*").alias("p")).withColumn("a", ablation.select(F.struct("*")).scalar())
    gates = {
        "market_neutral": F.abs(F.col("p.corr")) <= 0.15, "better_sharpe": F.col("p.sharpe") > F.col("a.sharpe"), "less_market": F.abs(F.col("p.corr")) < F.abs(F.col("a.corr")),
        "neutral_weights": (F.col("p.max_net") <= 1e-6) & (F.col("p.mean_gross") <= 1 + 1e-6), "enough_folds": F.lit(folds >= 2),
    }
    out = both.select(*(g.alias(n) for n, g in gates.items()))
    return out.withColumn("decision", F.when(~F.col("enough_folds"), "feasibility_only").when(F.array_position(F.array(*gates), False) == 0, "confirm").otherwise("reject"))


def market_reward(df: DataFrame, key: Sequence[str], time: str, own: str, market: str, turnover: str, window: int = 60, corr_weight: float = 1.0, cost_weight: float = 1.0, parts: int | None = None) -> DataFrame:
    """(own - market) / deviation - correlation and turnover terms, over the `window` rows before each."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        w = w.rowsBetween(-window, -1)
        sd, sm = F.stddev_pop(own).over(w), F.stddev_pop(market).over(w)
        corr = F.when((F.count(own).over(w) >= 2) & (sd > 1e-12) & (sm > 1e-12), try_ratio(F.covar_pop(own, market).over(w), sd * sm)).otherwise(0.0)
        sigma = F.greatest(F.coalesce(sd, F.lit(0.0)), F.lit(1e-8))
        return {"reward": (F.col(own) - F.col(market)) / sigma - corr_weight * corr - cost_weight * F.col(turnover)}

    return over(df, key, time, columns, before=window, parts=parts)


def scaled_position(df: DataFrame, key: Sequence[str], time: str, signal: str, sigma: str, ret: str, target: float = 0.15, cost_bps: float = 0.0) -> DataFrame:
    """Position signal * target / sigma and its return less the cost of changing it."""
    df = df.withColumn("position", F.col(signal) * try_ratio(F.lit(target), F.col(sigma)))
    change = F.abs(F.col("position") - F.lag("position", 1, 0.0).over(ordered(key, time)))
    return df.withColumn("net", F.col("position") * F.col(ret) - change * cost_bps / 1e4)


def simplex_projection(df: DataFrame, key: Sequence[str], value: str, order: str, out: str = "w") -> DataFrame:
    """The nearest weights that are not negative and sum to 1, by key."""
    w = Window.partitionBy(*key).orderBy(F.col(value).desc(), F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"__k": F.count("*").over(w), "__t": F.sum(value).over(w) - 1})
    theta = F.max_by(F.col("__t") / F.col("__k"), F.when(F.col(value) - F.col("__t") / F.col("__k") > 0, F.col("__k"))).over(Window.partitionBy(*key))
    return df.withColumn(out, F.greatest(F.col(value) - theta, F.lit(0.0))).drop("__k", "__t")


def invest_cash_reward(action: Column, previous: Column, ret: Column, cash: Column, cost: float = 0.001) -> Column:
    """The return less the cost of entering while invested (only from cash), else the cash rate."""
    return F.when(action == 1, ret - F.when(previous == 0, cost).otherwise(0.0)).otherwise(cash)


def mix_relations(edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of the relations' edges (rel, i, j, w), each row made to sum to 1."""
    wt = F.coalesce(*(F.when(F.col("rel") == r, F.lit(float(x))) for r, x in weights.items()), F.lit(0.0))
    mixed = edges.groupBy("i", "j").agg(F.sum(F.col("w") * wt).alias("w"))
    return mixed.withColumn("w", F.coalesce(try_ratio(F.col("w"), F.sum("w").over(Window.partitionBy("i"))), F.lit(0.0)))


def graph_message(edges: DataFrame, nodes: DataFrame, value: str = "x") -> DataFrame:
    """For each node the weighted sum of its neighbours' values."""
    return edges.join(nodes.select(F.col("node").alias("j"), value), "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("w") * F.col(value)).alias("message"))


def simulate_positions(df: DataFrame, key: str, time: str, signal: str, ret: str, long_size: float = 0.3, short_size: float = 0.3, cost_bps: float = 50.0, tax: float = 0.2) -> DataFrame:
    """One row: total_returns_pct, tax_paid_pct, net_returns_pct, sharpe_ratio, max_drawdown_pct, win_rate, num_trades, num_winning_trades, num_losing_trades, round_trips.

    df: a row for each key and time with a signal of -1, 0 or 1 and a return in percent. A position is a run of equal signals other than 0; its allocation is fixed when it is entered: the side's size over the
    number of the side's signals then. Entering and leaving cost `cost_bps` of it each, and it earns the return of every row of the run, the first too. A day's gain compounds the portfolio; the tax is on the total, if
    it is one. num_trades counts entries and exits, as num_winning_trades does wins at the exit (gain above its cost) or, of positions still open at the end, gains above 0; round_trips counts positions.
    Signals don't depend on results, so positions are window arithmetic by key and the portfolio is an aggregate by time; only the row of each time meets one task.
    """
    rate = cost_bps / 10_000
    df = df.select(F.col(key).alias("k"), F.col(time).alias("t"), F.col(signal).alias("s"), F.col(ret).alias("r"))
    w = Window.partitionBy("k").orderBy("t")
    side = F.count("*").over(Window.partitionBy("t", "s"))
    size = F.when(F.col("s") == 1, long_size).when(F.col("s") == -1, short_size).otherwise(0.0) / side
    new = F.col("s") != F.lag("s", 1, 0).over(w)
    df = df.withColumns({"size": size, "run": F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "enters": new})
    first = Window.partitionBy("k", "run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("alloc", F.first("size").over(first)).withColumn("gain", F.col("alloc") * F.col("r") / 100 * F.col("s"))
    left = F.when(F.col("enters"), F.coalesce(F.lag("alloc").over(w), F.lit(0.0))).otherwise(0.0)
    entered = F.when(F.col("enters"), F.col("alloc")).otherwise(0.0)
    days = df.withColumn("__c", (left + entered) * rate).groupBy("t").agg((F.sum("gain") - F.sum("__c")).alias("pnl"))
    over = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("v", F.product(1 + F.col("pnl")).over(over)).withColumn("dd", 1 - F.col("v") / F.greatest(F.lit(1.0), F.max("v").over(over)))
    last = F.max_by("v", "t")
    total = days.agg(((F.coalesce(last, F.lit(1.0)) - 1) * 100).alias("total_returns_pct"), F.coalesce(F.sqrt(F.lit(252.0)) * try_ratio(F.avg("pnl"), F.stddev_pop("pnl")), F.lit(0.0)).alias("sharpe_ratio"), F.coalesce(100 * F.greatest(F.max("dd"), F.lit(0.0)), F.lit(0.0)).alias("max_drawdown_pct"))
    runs = df.filter("s <> 0").groupBy("k", "run").agg(F.sum("gain").alias("g"), F.first("alloc").alias("a"), F.max("t").alias("t"))
    ends = df.groupBy("k").agg(F.max("t").alias("__e"))
    closed = F.col("t") < F.col("__e")
    wins = F.when(closed, F.col("g") > rate * F.col("a")).otherwise(F.col("g") > 0)
    trades = runs.join(ends, "k").agg((F.count("*") + F.count_if(closed)).alias("num_trades"), F.count_if(wins).alias("num_winning_trades"), F.count("*").alias("round_trips"))
    both = total.crossJoin(trades)  # a row each
    return both.select(
        "total_returns_pct", F.greatest(F.col("total_returns_pct") * tax, F.lit(0.0)).alias("tax_paid_pct"), (F.col("total_returns_pct") - F.greatest(F.col("total_returns_pct") * tax, F.lit(0.0))).alias("net_returns_pct"), "sharpe_ratio", "max_drawdown_pct",
        F.coalesce(try_ratio(F.col("num_winning_trades").cast("double"), F.col("num_trades").cast("double")), F.lit(0.0)).alias("win_rate"), "num_trades", "num_winning_trades", (F.col("num_trades") - F.col("num_winning_trades")).alias("num_losing_trades"), "round_trips",
    )


def simulate_open_to_open(df: DataFrame, key: Sequence[str], time: str, signal: str, opened: str, cost: float = 0.005, tax: float = 0.2) -> DataFrame:
    """By key: trades, win_rate, total_return_pct, tax_paid_pct, net_return_pct, proven.

    A signal of -1, 0 or 1 that differs from the position (none at first) closes it and opens the new one at the row's open; rows without a signal are passed over. A closed long earns exit / entry - 1, a short entry / exit - 1, each
    less the cost, and compounds; what is open at the end isn't counted. The tax is on the total, if it is one. All is window arithmetic over the rows where the signal changes.
    """
    w = ordered(key, time)
    rows = df.filter(F.col(signal).isNotNull()).withColumn("__b", F.lag(signal, 1, 0).over(w)).filter(F.col(signal) != F.col("__b"))
    entry = F.lag(opened).over(w)
    made = F.when(F.col("__b") == 1, try_ratio(F.col(opened), entry) - 1).when(F.col("__b") == -1, try_ratio(entry, F.col(opened)) - 1) - cost
    out = rows.withColumn("__n", made).groupBy(*key).agg(F.count("__n").alias("trades"), F.count_if(F.col("__n") > 0).alias("wins"), ((F.coalesce(F.product(1 + F.col("__n")), F.lit(1.0)) - 1) * 100).alias("total_return_pct"))
    out = df.select(*key).distinct().join(out, list(key), "left").na.fill({"trades": 0, "wins": 0, "total_return_pct": 0.0})
    taxed = F.greatest(F.col("total_return_pct") * tax, F.lit(0.0))
    out = out.withColumns({"win_rate": F.coalesce(try_ratio(F.col("wins").cast("double"), F.col("trades").cast("double")), F.lit(0.0)), "tax_paid_pct": taxed, "net_return_pct": F.col("total_return_pct") - taxed})
    return out.withColumn("proven", F.col("net_return_pct") > 0).drop("wins")


#: Fixed values of the paper: market -> (basis points a side for the most traded tenth, for the others, and a year for borrowed positions).
EXECUTION_COSTS = {"us_large_cap": (5.0, 15.0, 30.0), "uk_germany": (10.0, 15.0, 45.0), "hong_kong": (10.0, 20.0, 75.0), "china_proxy": (30.0, 30.0, 120.0)}


def execution_cost(market: Column, top_decile: Column, traded: Column, short: Column) -> Column:
    """Cost of a day: the traded weight at the market's rate, and a day of the fee on the short weight. An unknown market stops the run."""
    row = F.raise_error(F.concat(F.lit("unknown market: "), market)).cast("struct<a:double,b:double,c:double>")
    for name, (a, b, c) in EXECUTION_COSTS.items():
        row = F.when(market == name, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))).otherwise(row)
    return traded * F.when(top_decile, row["a"]).otherwise(row["b"]) / 1e4 + short * row["c"] / 1e4 / 252


def paper_reward(action: Column, before: Column, sigma_target: Column, sigma: Column, sigma_before: Column, ret: Column, price: Column, cost_rate: Column, mu: float = 1.0) -> Column:
    """Reward of an action in -1, 0, 1 scaled to a target volatility, less the cost of changing the scaled position from the action before. Arguments out of range stop the run."""
    now, then = sigma_target / sigma * action, sigma_target / sigma_before * before
    ok = action.isin(-1, 0, 1) & before.isin(-1, 0, 1) & (F.least(sigma_target, sigma, sigma_before) > 0) & (price > 0) & (cost_rate >= 0) & F.lit(mu > 0)
    return F.when(ok, mu * (now * ret - cost_rate * price * F.abs(now - then))).otherwise(F.raise_error(F.lit("action, volatility, price, cost rate or mu out of range")).cast("double"))


def signal_returns(signals: DataFrame, returns: DataFrame, key: str, time: str) -> DataFrame:
    """Each signal with its key's return of the same time; without one, 0."""
    return signals.join(returns.select(key, time, "ret"), [key, time], "left").na.fill(0.0, ["ret"])


#: Rounds of the block iteration at most, and the residual |Gv - lambda v| / lambda at which it ends.
PCA_ROUNDS, PCA_RESIDUAL = 500, 1e-10


def _standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(z array<double>): rows with all columns' z-scores by sample deviation; 0 without spread and where a value is missing. Means and deviations are one aggregate by column."""
    long = df.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("i", "x"))
    found = {r.i: r for r in long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect()}
    mean = [float(found[i].m or 0.0) if i in found else 0.0 for i in range(len(columns))]
    scale = [1.0 / found[i].s if i in found and found[i].s and found[i].s > 1e-12 else 0.0 for i in range(len(columns))]
    centred = F.zip_with(F.array(*(F.col(c).cast("double") for c in columns)), F.lit(mean), lambda x, m: F.coalesce(x - m, F.lit(0.0)))
    return df.select(F.zip_with(centred, F.lit(scale), lambda x, s: x * s).alias("z"))


def pca_factors(df: DataFrame, date: str, columns: Sequence[str], k: int = 3, alpha: float = 0.1) -> DataFrame:
    """(component, eigenvalue, explained, loadings map): principal axes of the z-scored columns, their Gram matrix G = Z'Z / rows shrunk to the unit matrix by alpha.

    explained: the eigenvalue's share of the k found. G is never made: each round multiplies the stored rows with a block of k + 8 vectors, Z'(ZB), in one
    pass whose partial results are columns x block, and the block is made orthogonal on the driver (Rayleigh-Ritz), until the k residuals are below
    PCA_RESIDUAL; not reaching it in PCA_ROUNDS is an error. So thousands of columns need neither squared aggregates nor a square matrix.
    The largest loading of each component is positive. Without rows, or where no column varies, G is alpha times the unit matrix.
    """
    import numpy as np
    import pyarrow as pa

    n = len(columns)
    z = storage.stash(_standard(df, columns))
    rows, size = z.count(), min(n, k + 8)

    def times(block):
        def run(batches):
            total = np.zeros((n, size))
            for b in batches:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n)
                    total += x.T @ (x @ block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array(list(total))], names=["i", "v"])

        parts = z.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
        out = np.zeros((n, size))
        for i, j, x in parts.collect():
            out[i, j] = x
        return (1 - alpha) * out / max(1, rows) + alpha * block

    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((n, size)))[0]
    for _ in range(PCA_ROUNDS):
        product = times(basis)
        values, turn = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, product = basis @ turn, product @ turn
        least = np.abs(values[:k]).clip(1e-300)
        if (np.linalg.norm(product[:, :k] - vectors[:, :k] * values[:k], axis=0) <= PCA_RESIDUAL * least).all():
            break
        basis = np.linalg.qr(product)[0]
    else:
        raise ValueError(f"the components did not settle in {PCA_ROUNDS} rounds")
    found, total = [], float(values[:k].sum())
    for c in range(min(k, n)):
        v = vectors[:, c] * (1 if vectors[np.abs(vectors[:, c]).argmax(), c] > 0 else -1)
        found.append((c, float(values[c]), float(values[c] / total), dict(zip(columns, map(float, v), strict=True))))
    return df.sparkSession.createDataFrame(found, "component int, eigenvalue double, explained double, loadings map<string,double>")


def pca_scores(df: DataFrame, date: str, columns: Sequence[str], factors: DataFrame) -> DataFrame:
    """(date, pc1, pc2, ...): the z-scored columns (sample deviation; 0 without spread) times each component's loadings."""
    loadings = {r.component: r.loadings for r in factors.collect()}  # components times columns
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    z = {c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"]) if stats[f"s_{c}"] else F.lit(0.0) for c in columns}
    return df.select(date, *(sum((z[c] * float(v[c]) for c in columns), F.lit(0.0)).alias(f"pc{i + 1}") for i, v in sorted(loadings.items())))


def mean_variance_moments(mu: Sequence[float], sigma: Sequence[Sequence[float]], beta: float, wealth: float = 1.0, horizon: float = 1.0) -> tuple[float, float]:
    """Mean and variance of the closed-form optimum, from R = mu' Sigma^-1 mu."""
    import numpy as np

    m = np.asarray(mu)
    r = float(m @ np.linalg.solve(np.asarray(sigma), m)) * horizon
    gain = math.exp(r) - 1
    return wealth + gain / (2 * beta), gain / (4 * beta * beta)


def monte_carlo_wealth(spark: SparkSession, paths: int, steps: int, mu: float | Sequence[float], sigma: float | Sequence[float], seed: int = 1, weights: Sequence[float] = (1.0,), corr: Sequence[Sequence[float]] | None = None, wealth: float = 1.0, horizon: float = 1.0) -> DataFrame:
    """Mean and variance of the final wealth of paths over correlated geometric Brownian assets, in one distributed aggregate.

    Each step is drawn: wealth * (1 + sum of weights * simple returns), so that the portfolio is brought back to its weights at every step.
    mu and sigma are annual, one for each weight or one for all; corr: the correlations of the assets, else none. What the weights leave is held at no return.
    """
    import numpy as np

    n, dt = len(weights), horizon / steps
    mu, sigma = (np.broadcast_to(np.asarray(x, float), (n,)) for x in (mu, sigma))
    root, held, drift = np.linalg.cholesky(np.eye(n) if corr is None else np.asarray(corr, float)), np.asarray(weights, float), (mu - sigma**2 / 2) * dt

    def run(batches):
        for pdf in batches:
            for low in range(0, len(pdf), 5000):
                ids = pdf["id"].to_numpy()[low : low + 5000]
                rng, w = np.random.default_rng([seed, int(ids[0])]), np.full(len(ids), wealth)
                for _ in range(steps):
                    moves = rng.standard_normal((len(ids), n)) @ root.T * math.sqrt(dt)
                    w = w * (1 + np.expm1(drift + sigma * moves) @ held)
                yield pd.DataFrame({"w": w})

    return spark.range(paths).mapInPandas(run, "w double").agg(F.avg("w").alias("mean"), F.var_pop("w").alias("variance"), F.count("*").alias("n"))


def _window_sums(rows: DataFrame, key: Sequence[str], weight: str, values: Sequence[str], window: int) -> DataFrame:
    """(__t, values): for each date the weighted sums of the values over the `window` dates before it, by differences of running sums.

    rows: key, __t, weight and values. Those of date t weigh the window that ends with t, for date t + 1. Each row is met twice, whatever
    the window: where its running sum ends the window, and `window` dates before, where the sum is taken off.
    """
    ends = rows.select(*key, F.col("__t").alias("__at"), F.lit(0).alias("__kind"), F.col("__t").alias("__of"), weight, *values)
    begins = rows.select(*key, (F.col("__t") - window).alias("__at"), F.lit(1).alias("__kind"), F.col("__t").alias("__of"), (-F.col(weight)).alias(weight), *(F.lit(0.0).alias(v) for v in values))
    w = Window.partitionBy(*key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    running = ends.unionByName(begins).withColumns({f"__p_{v}": F.sum(v).over(w) for v in values})
    return running.groupBy((F.col("__of") + 1).alias("__t")).agg(*(F.sum(F.col(weight) * F.col(f"__p_{v}")).alias(v) for v in values))


def reapplied_window(df: DataFrame, date: str, asset: str, weight: str, ret: str, market: str, window: int = 60) -> DataFrame:
    """(date, sigma, corr): for each date the weights of the date before it, applied to the assets' returns of the `window` dates before it: deviation (1e-8 at least) and correlation with the market.

    The first date has no weights before it: 1e-8 and 0. A missing weight or return counts 0, a date without a market return isn't in the correlation.
    The deviation is that of w' C w, where C comes from running sums of products for each pair of assets: the work doesn't depend on
    the window. Spread below a millionth of the returns' size is none.
    """
    days = numbered(df.groupBy(date).agg(F.first(market, ignorenulls=True).alias("__m")), [], date, "__t")
    held = df.join(days, date).select(F.col(asset).alias("__a"), "__t", F.coalesce(weight, F.lit(0.0)).alias("__w"), F.coalesce(ret, F.lit(0.0)).alias("__r"), "__m")
    one = held.withColumns({"r": F.col("__r"), "rk": F.when(F.col("__m").isNotNull(), F.col("__r")).otherwise(0.0), "rm": F.coalesce(F.col("__r") * F.col("__m"), F.lit(0.0))})
    other = held.select("__t", F.col("__a").alias("__b"), F.col("__w").alias("__v"), F.col("__r").alias("__q"))
    pairs = held.join(other, "__t").filter("__a <= __b").select("__a", "__b", "__t", (F.col("__w") * F.col("__v") * F.when(F.col("__a") == F.col("__b"), 1.0).otherwise(2.0)).alias("__ww"), (F.col("__r") * F.col("__q")).alias("rr"))
    sums = _window_sums(one, ["__a"], "__w", ["r", "rk", "rm"], window).join(_window_sums(pairs, ["__a", "__b"], "__ww", ["rr"], window), "__t")
    past = lambda w: w.rowsBetween(-window, -1)
    market_ = over(days, [], "__t", lambda w: {"__n": F.count("*").over(past(w)), "__k": F.count("__m").over(past(w)), "__sm": F.stddev_pop("__m").over(past(w)), "__mm": F.avg("__m").over(past(w))}, before=window)
    both = market_.join(sums, "__t", "left")
    square, mean = F.col("rr") / F.col("__n"), F.col("r") / F.col("__n")
    variance = F.when(square - mean * mean > 1e-12 * square, square - mean * mean).otherwise(0.0)
    # the spread of the portfolio over the dates with a market return is taken over all dates, as its deviation is
    cov = try_ratio(F.col("rm"), F.col("__k")) - try_ratio(F.col("rk"), F.col("__k")) * F.col("__mm")
    sd = F.sqrt(F.coalesce(variance, F.lit(0.0)))
    corr = F.when((F.col("__n") >= 2) & (sd > 1e-12) & (F.col("__sm") > 1e-12), try_ratio(cov, sd * F.col("__sm"))).otherwise(0.0)
    return both.select(date, F.greatest(sd, F.lit(1e-8)).alias("sigma"), F.coalesce(corr, F.lit(0.0)).alias("corr"))
