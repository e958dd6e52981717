"""Universe choice and panel preparation."""

import datetime as dt
import math
import random

import pytest

from marlstone.operators import panel, quality

DAY = dt.date(2020, 1, 1)


def prices(spark, rows):
    return spark.createDataFrame([(DAY + dt.timedelta(days=d), c, float(p), float(v)) for d, c, p, v in rows], "Date date, Code string, Close double, Volume double")


def test_universe(spark):
    rows = [(d, "a", 1, 100) for d in range(5)] + [(d, "b", 2, 100) for d in range(5)] + [(d, "c", 9, 900) for d in range(4)] + [(d, "d", 2, 100) for d in range(5)] + [(30 + d, "e", 99, 999) for d in range(50)]
    got = panel.choose_universe(prices(spark, rows), DAY + dt.timedelta(days=10), 2)
    assert [(r.Code, r.days) for r in got.collect()] == [("b", 5), ("d", 5)]  # c lacks a day, e comes after the cutoff
    for cutoff, most in ((DAY - dt.timedelta(days=1), 5), (DAY, 1)):
        with pytest.raises((ValueError, quality.QualityError)):
            panel.choose_universe(prices(spark, rows), cutoff, most)
    many = [(d, c, 1, 1) for c, n in (("x", 80), ("y", 60), ("z", 59)) for d in range(n)]
    assert {r.Code for r in panel.choose_universe(prices(spark, many), DAY + dt.timedelta(days=99), 9).collect()} == {"x", "y"}


def test_panel_ends_on_dates_that_all_have(spark):
    rng = random.Random(1)
    rows = [(d, c, rng.uniform(1, 2), rng.uniform(1, 9)) for d in range(40) for c in "abc" if (d, c) != (20, "b")]
    rows.append((25, "d", 0, 0))
    bench = spark.createDataFrame([(DAY + dt.timedelta(days=d), None if d == 30 else 0.01 * d) for d in range(40) if d != 31], "Date date, benchmark double")
    for parts in (None, 3):
        out = panel.prepared_panel(prices(spark, rows), bench, DAY + dt.timedelta(days=10), 3, windows=(2, 3), least_dates=10, parts=parts)
        days = {(r.Date - DAY).days for r in out.collect()}
        assert days == set(range(1, 40)) - {20, 30, 31} and out.count() == 3 * len(days)  # date 0 has no return; 21's counts from 19
        x = {(r.Date, r.Code): r for r in out.collect()}
        close = {(d, c): p for d, c, p, _ in rows}
        assert math.isclose(x[DAY + dt.timedelta(days=21), "b"].asset_return, math.log(close[21, "b"] / close[19, "b"]), rel_tol=1e-9)
        assert math.isclose(x[DAY + dt.timedelta(days=7), "a"].benchmark, 0.07)
        z = [x[DAY + dt.timedelta(days=9), c].momentum_3 for c in "abc"]
        assert abs(sum(z)) < 1e-9 and math.isclose(sum(v * v for v in z) / 3, 1, rel_tol=1e-9)
    with pytest.raises(quality.QualityError):
        panel.prepared_panel(prices(spark, rows), bench, DAY + dt.timedelta(days=10), 3, windows=(2, 3))
