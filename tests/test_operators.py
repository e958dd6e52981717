"""Operators on the small literals that their definitions pin."""

import json
import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalars as S
from marlstone.operators import claims, facts, feeds, portfolio, quality, stats
from marlstone.operators import relational as R
from marlstone.operators import timeseries as TS


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_scalars(spark):
    L = F.lit
    r = one(
        spark, code=S.security_code(L("72030")), code2=S.security_code(L("285A")), bad=S.valid_security_code(L("12B4")), good=S.valid_security_code(L("285A")), n=S.parse_double(L("－")), n2=S.parse_double(L(" 1.5 ")), i=S.parse_int_prefix(L("12abc")), i2=S.parse_int_prefix(L("abc")),
        pct=S.parse_percent(L("1,234.5%")), y98=S.parse_year(L("'98")), y05=S.parse_year(L("05")), ye=S.parse_year(L("2005e")), alias=S.alias_key(L("Tes_t  株式・会社!")), short=S.alias_key(L("a-b")), word=S.has_term(L("meta\n data"), "meta data"), inside=S.has_term(L("metadata"), "data"),
        month=S.month_key(L("2020-02-29")), nomonth=S.month_key(L("2020-13-01")), close=S.is_close(L(1.0), L(1.0 + 1e-10)), size=S.byte_size(L(1536)), host=S.url_host(L("https://a.b/c")), up=S.safe_path(L("a/../b")), ok=S.safe_path(L("a/b.c")),
        ratio=S.safe_ratio(L(1.0), L(-1.0)), snip=S.snippet(L("x" * 301)), lst=S.string_list(L('["a","b"]')), same=S.same_sizes(F.array(L(1)), F.array(L(2))), filled=S.first_filled(L(""), L("b")), dens=S.keyword_density(L("bad " * 20 + "worse"), ["bad", "worse"]), us=S.us_date(L("01/31/2020")).cast("string"), act=S.squash(L(2.0)), rev=S.regime_direction(L(3.0), L(1)),
    )
    assert (r.code, r.code2, r.bad, r.good, r.n, r.n2, r.i, r.i2, r.pct) == ("7203", "285A", False, True, None, 1.5, 12, None, 1234.5)
    assert (r.y98, r.y05, r.ye, r.alias, r.short, r.word, r.inside) == (1998, 2005, 2005, "test株式会社", None, True, False)
    assert (r.month, r.nomonth, r.close, r.size, r.host, r.up, r.ok, r.ratio) == ("2020-02", None, True, "1.5 KB", "a.b", False, True, None)
    assert len(r.snip) == 303 and r.lst == ["a", "b"] and r.same and r.filled == "b" and r.us == "2020-01-31" and r.act.action == "long" and r.rev == -1
    assert r.dens == round(21 / 85 * 1000, 2) and S.column_name("10 Yr (%)") == "10_yr"


def test_crosstab_and_unknown(spark):
    df = spark.createDataFrame([("05-01", "P"), ("05-01", "S"), ("05-01", "P"), ("05-02", "S")], "d string, t string")
    assert [tuple(r) for r in R.crosstab(df, "d", "t", ["P", "S"]).orderBy("d").collect()] == [("05-01", 2, 1, 3), ("05-02", 0, 1, 1)]
    with pytest.raises(Exception, match="unknown"):
        R.crosstab(df, "d", "t", ["P"]).collect()


def test_revision_pair(spark):
    month = lambda *v: spark.createDataFrame([(f"2020-0{i}", x) for i, x in enumerate(v, 1)], "m string, v double")
    r = stats.revision_stats(month(0.01, -0.02, 0.03), month(0.0101, -0.02, 0.0298), "m", "v").first()
    assert (r.months, r.changed) == (3, 2) and math.isclose(r.mean_bps, -1 / 3, abs_tol=1e-9) and math.isclose(r.mean_abs_bps, 1, abs_tol=1e-9) and math.isclose(r.max_abs_bps, 2, abs_tol=1e-9)


def test_neutral_and_path(spark):
    v = spark.createDataFrame([(1, i, x) for i, x in enumerate((3.0, -1.0, 2.0, 0.0))], "d int, a int, w double")
    w = [r.o for r in portfolio.neutral_weights(v, "d", "w", "o").collect()]
    assert abs(sum(w)) < 1e-9 and abs(sum(map(abs, w)) - 1) < 1e-9
    rows = [(t, a, x, r) for t, (ws, rs) in enumerate(zip(((2, -1), (1, -1), (-1, 1)), ((0.01, -0.01), (0.02, -0.01), (-0.01, 0.02)), strict=True)) for a, (x, r) in enumerate(zip(ws, rs, strict=True))]
    p = portfolio.weight_path(spark.createDataFrame([(t, a, float(x), r) for t, a, x, r in rows], "t int, a int, w double, r double"), "a", "t", "w", "r").orderBy("t").collect()
    assert len(p) == 3 and all(abs(x.net_exposure) < 1e-6 and x.gross <= 1 + 1e-9 for x in p) and [round(x.turnover, 9) for x in p] == [1, 0, 2]
    b = spark.createDataFrame([(0, 0.005), (1, 0.004), (2, -0.002)], "t int, b double")
    assert portfolio.path_metrics(spark.createDataFrame(p), b, "t", "b").first().n == 3


@pytest.mark.parametrize(("first", "last", "folds"), [("2019-01-01", "2023-12-29", 3), ("2010-07-01", "2024-12-31", 22)])
def test_folds(spark, first, last, folds):
    f = portfolio.walk_forward_folds(spark, first, last).collect()
    assert len(f) == folds and str(f[0].test_start)[:7] == str(int(first[:4]) + 3 + (int(first[5:7]) + 5) // 12) + f"-{(int(first[5:7]) + 5) % 12 + 1:02d}"


def test_simplex_blocks_relations(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate((-0.2, 0.2, 0.7, 0.4))], "k int, i int, v double")
    w = [r.w for r in portfolio.simplex_projection(df, ["k"], "v", "i").orderBy("i").collect()]
    assert abs(sum(w) - 1) < 1e-9 and min(w) >= 0
    x = spark.createDataFrame([(1, i, 0.01 * (i - 3)) for i in range(8)], "k int, i int, v double")
    total = sum((0.01 * (i - 3)) ** 2 for i in range(8))
    for size, n in ((1, 8), (2, 4), (4, 2), (8, 1), (3, 3)):
        b = TS.blocks(x, ["k"], "i", "v", size).collect()
        assert len(b) == n and math.isclose(sum(r.realized for r in b), total)
    e = spark.createDataFrame([("a", 0, 1, 1.0), ("b", 0, 2, 3.0), ("b", 1, 0, 2.0)], "rel string, i int, j int, w double")
    mixed = portfolio.mix_relations(e, {"a": 0.5, "b": 0.5})
    assert all(math.isclose(r.s, 1) for r in mixed.groupBy("i").agg(F.sum("w").alias("s")).collect())
    cash = one(spark, a=portfolio.invest_cash_reward(F.lit(1), F.lit(0), F.lit(0.03), F.lit(0.0)), b=portfolio.invest_cash_reward(F.lit(1), F.lit(1), F.lit(0.03), F.lit(0.0)))
    assert (round(cash.a, 6), round(cash.b, 6)) == (0.029, 0.03)


def test_series_guards(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate((100.0, 110.0, None, 0.0, 121.0))], "k int, t int, p double")
    assert [r.ret and round(r.ret, 6) for r in TS.simple_return(df, ["k"], "t", "p").orderBy("t").collect()] == [None, 0.1, None, None, None]
    assert [r.mean_2 for r in TS.rolling(df, ["k"], "t", "p", 2).orderBy("t").collect()] == [None, 105.0, None, None, 60.5]
    r = spark.createDataFrame([(1, i, v) for i, v in enumerate((-0.1, 0.05, -0.2))], "k int, t int, r double")
    dd = lambda **k: round(TS.max_drawdown(r, ["k"], "t", "r", **k).first().max_drawdown, 9)
    assert dd() == round(0.9 * 1.05 * 0.8 - 1, 9) and dd(include_initial=False) == -0.2 and dd(positive_percent=True) == round(100 - 75.6, 9)
    s = one(spark, m=TS.multiscale_window(F.array(*map(F.lit, range(10))), F.lit(9), (1, 5), 3))
    assert s.m == [[7, 8, 9], [0, 4, 9]]
    assert TS.gaps(spark.createDataFrame([(1, 2020), (1, 2021), (1, 2023)], "k int, y int"), ["k"], "y").first().y == 2023


def test_newey_west_and_metrics(spark):
    import random

    rng = random.Random(4)
    x = [rng.gauss(0.01, 0.05) for _ in range(60)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, t int, r double")
    n, m = len(x), sum(x) / len(x)
    c = [v - m for v in x]
    lrv = sum(v * v for v in c) / n + 2 * sum((1 - k / 7) * sum(c[i] * c[i - k] for i in range(k, n)) / n for k in range(1, 7))
    assert math.isclose(stats.newey_west(df, ["k"], "t", "r").first().t_nw, m / math.sqrt(lrv / n), rel_tol=1e-9)
    got = stats.factor_metrics(df, ["k"], "t", "r").first()
    wealth = math.prod(1 + v for v in x)
    assert math.isclose(got.cumulative, wealth - 1) and math.isclose(got.cagr, wealth ** (12 / n) - 1) and got.hit_rate == sum(v > 0 for v in x) / n
    flat = spark.createDataFrame([(1, i, 0.01) for i in range(5)], "k int, t int, r double")
    assert stats.factor_metrics(flat, ["k"], "t", "r").first().sharpe is None and flat.agg(stats.sharpe("r").alias("s")).first().s == 0
    lo, hi = stats.moving_block_ci(df, "t", "r", reps=500).first()
    assert lo < 12 * m < hi and stats.moving_block_ci(df, "t", "r", reps=500).first() == (lo, hi)


def test_frozen_split(spark):
    rows = [(f"d{i}{g}", g) for g in ("a", "b", "c") for i in range(5)] + [("single", "z")]
    df = spark.createDataFrame(rows, "doc_id string, g string")
    got = {r.doc_id for r in quality.frozen_split(df, "doc_id", "g").filter("evaluation").collect()}
    assert len(got) == 3 and "single" not in got
    assert got == {r.doc_id for r in quality.frozen_split(df.orderBy(F.desc("doc_id")).repartition(3), "doc_id", "g").filter("evaluation").collect()}
    for bad in (df.union(df.limit(1)), df.unionByName(spark.createDataFrame([(None, "a")], df.schema))):
        with pytest.raises(quality.QualityError):
            quality.frozen_split(bad, "doc_id", "g")
    with pytest.raises(quality.QualityError):
        quality.frozen_split(df, "doc_id", "g", expected=3)


def test_snapshot_audit(spark):
    good = {"dataset_id": "d", "reuse_key": "k", "observed_at": "2026-01-01T00:00:00Z", "artifact_sha256": "ab", "artifact_path": "x/y.json", "status": "ok", "provenance": {"url": "u"}}
    schema = "snapshot_id string, dataset_id string, reuse_key string, observed_at string, artifact_sha256 string, artifact_path string, status string, provenance map<string,string>"
    import hashlib

    sid = hashlib.sha256("d|k|2026-01-01T00:00:00Z|ab".encode()).hexdigest()[:20]
    later = {**good, "observed_at": "2026-01-01T10:00:00+09:00"}
    bad = [{"snapshot_id": sid, **good}, {"snapshot_id": "wrong", **later, "artifact_path": "../z"}]
    df = spark.createDataFrame(bad, schema)
    assert {r.rule for r in quality.audit_snapshots(df, ["url", "license"]).collect()} == {"safe_path", "snapshot_id", "provenance"}
    quality.assert_empty(quality.audit_snapshots(df.limit(1), ["url"]))
    assert quality.latest_snapshot(df).first().snapshot_id == "wrong"  # 01:00 UTC


def test_rules(spark):
    bars = spark.createDataFrame([("A", "d1", 1.0, 2.0), ("A", "d2", float("nan"), float("nan")), ("B", "d1", None, 1.0)], "Code string, Date string, AdjustmentClose double, AdjustmentVolume double")
    symbols = spark.createDataFrame([("A",), ("B",), ("C",)], "Code string")
    assert {(r.rule, r.key) for r in quality.bar_rules(bars, symbols).collect()} == {("nan_AdjustmentClose", "A"), ("warn_nan_AdjustmentVolume", "A"), ("missing_AdjustmentClose", "B"), ("no_records", "C")}
    assert {(r.Code, r.records, r.valid) for r in quality.bar_validity(bars.filter("Date = 'd1'"), symbols).collect()} == {("A", 1, True), ("B", 1, False), ("C", 0, False)}
    ledger = spark.createDataFrame([("s1", "csv", "a/b"), ("s2", "csv", "/abs"), ("s3", "x", "a/b")], "source_id string, adapter string, path string")
    reg = spark.createDataFrame([("s1", True, True, "csv"), ("s2", False, True, "csv")], "source_id string, enabled boolean, fail_closed boolean, adapter string")
    assert {r.rule for r in quality.audit_ledger(ledger, reg).collect()} == {"enabled", "safe_path", "registered", "unique_path"} - {"unique_path"} | {"unique_key"}
    state = spark.createDataFrame([(1, "NOT_RUN", "ok", None), (2, "BLOCKED", None, "m"), (3, "COMPLETE", "ok", "m")], "id int, state string, verdict string, metrics string")
    assert {r.rule for r in quality.state_rules(state).collect()} == {"not_run_verdict", "blocked_metrics"}
    j = spark.createDataFrame([(1, '{"a":{"secret": 1}}'), (2, '{"a":"secret"}')], "id int, j string")
    assert [r.key for r in quality.forbidden_keys(j, "id", "j", ["secret"]).collect()] == ["1"]
    p = spark.createDataFrame([('{"Note":"x"}',), ('{"Time Series (Daily)":{}}',), ("{}",)], "j string")
    assert [r.s for r in p.select(quality.provider_state(F.col("j")).alias("s")).collect()] == ["rate_limited", "supported", "invalid"]
    assert quality.same_keys(j, spark.createDataFrame([(2,), (3,)], "id int"), ["id"]).count() == 2
    assert quality.require_columns(j.limit(0), ["id", "zz"]).count() == 2 and quality.row_count(j, 2).isEmpty()
    with pytest.raises(quality.QualityError):
        quality.assert_empty(quality.unique_key(j.union(j), ["id"]))


def test_joins(spark):
    left = spark.createDataFrame([("7203",), ("72030",), ("9999",)], "code string")
    side = spark.createDataFrame([("72030", "T")], "c string, name string")
    assert [r.name for r in R.padded_lookup(left, side, "code", "c", ["name"]).orderBy("code").collect()] == ["T", "T", None]
    with pytest.raises(ValueError):
        R.complete_inner(left, side.withColumnRenamed("c", "code"), ["code"])
    facts_ = spark.createDataFrame([("f1", "m1"), ("f1", "m2"), ("f2", "m1")], "feed string, metric string")
    claims = spark.createDataFrame([("c", ["f1", "f1"], ["m1"])], "claim string, feeds array<string>, metrics array<string>")
    assert R.membership(facts_, claims, {"feed": "feeds", "metric": "metrics"}).count() == 1
    ids = spark.createDataFrame([("x", ["1", "2", "9"]), ("y", [])], "n string, ids array<string>")
    look = spark.createDataFrame([("1", "t2"), ("2", "t1")], "id string, theme string")
    assert [r.themes for r in R.map_ids(ids, "ids", look, "id", "theme", "themes").orderBy("n").collect()] == [["t1", "t2"], []]
    old, new = (spark.createDataFrame(x, "k string, a string, b string") for x in ([("1", "x", None), ("2", "y", "z")], [("1", "x", "n"), ("3", "q", None)]))
    got = {(r.k, r.status, r.field) for r in R.snapshot_diff(old, new, "k", ["a", "b"]).collect()}
    assert got == {("1", "modified", "b"), ("2", "removed", "a"), ("2", "removed", "b"), ("3", "added", "a")}
    assert R.unchanged(old, old) and not R.unchanged(old, new)
    assert R.decision_counts(spark.createDataFrame([("a", "S")], "c string, d string"), "c", "d", ["S", "R"]).count() == 2
    fb = R.fallback_join(spark.createDataFrame([("a", "n1"), ("z", "n2"), ("z", "q")], "k string, n string"), spark.createDataFrame([("a", "n9", 1), ("b", "n2", 2)], "k2 string, n2 string, v int"), [(F.col("k"), "k2"), (F.col("n"), "n2")], ["v"])
    assert sorted((r.n, r.v) for r in fb.collect()) == [("n1", 1), ("n2", 2), ("q", None)]


def facts_by(spark, name, payload, array=None):
    """Facts of a JSON payload."""
    df = json_frame(spark, payload)
    return feeds.apply_adapter(name, feeds.records(df, array) if array else df).collect()


def json_frame(spark, payload):
    text = json.dumps(payload)
    schema = spark.range(1).select(F.schema_of_json(F.lit(text))).first()[0]
    return spark.createDataFrame([(text,)], "value string").select(F.from_json("value", schema).alias("p")).select("p.*")


def test_vehicle_feed_makes_no_rate(spark):
    payload = {
        "california_dmv": {"autonomous_testing_miles": 1000.0, "company_permit_group_count": 2, "reported_disengagements": 4, "metric_warning": "not a safety rate", "period": {"end": "2024-11-30"}, "source_urls": ["https://www.dmv.ca.gov/source"]},
        "nhtsa_sgo": {"ads": {"report_count_2024_plus": 7}, "level_2_adas": {"report_count_2024_plus": 9}, "comparison_warning": "not exposure normalized", "source_page": "https://www.nhtsa.gov/source"},
    }
    rows = facts_by(spark, "autonomous_vehicles_summary", payload)
    assert [(r.metric_id, r.value, r.unit, r.entity) for r in rows][:3] == [("autonomous_testing_miles", 1000.0, "miles", "California DMV autonomous testing"), ("reported_disengagements", 4.0, "events", "California DMV autonomous testing"), ("permitted_company_groups", 2.0, "company_groups", "California DMV autonomous testing")]
    assert [(r.entity, r.value, r.fact_class, r.dimensions) for r in rows[3:]] == [("ADS", 7.0, "domain_derived", {"warning": "not exposure normalized"}), ("Level 2 ADAS", 9.0, "domain_derived", {"warning": "not exposure normalized"})]


def test_derivatives_feed_keeps_kinds_apart(spark):
    payload = {"records": [{"date": "2026-08-19", "contract_type": "PERPETUAL", "symbol": "BTCUSDT", "funding_rate_sum": 0.0001, "perpetual_premium_pct": -0.03}, {"date": "2026-08-19", "contract_type": "CURRENT_QUARTER", "symbol": "BTCUSDT_260925", "annualized_delivery_basis_pct": 2.1}]}
    by = {}
    for r in facts_by(spark, "bitcoin_derivatives_daily", payload, "records"):
        by.setdefault(r.entity, set()).add(r.metric_id)
    assert by == {"BTCUSDT": {"funding_rate_sum", "perpetual_premium_pct"}, "BTCUSDT_260925": {"annualized_delivery_basis_pct"}}


def test_robotics_feed(spark):
    record = {"company": "Example Corp", "factory": "Plant A", "country": "JP", "deployment_stage": "production", "equipment_type": "industrial_robot", "status": "operational", "observed_at": "2026-04-01", "source_url": "https://example.com/official", "quantity": 4, "quantity_unit": "industrial_robots", "quantity_qualifier": "exact"}
    rows = {r.metric_id: r for r in facts_by(spark, "robotics_deployments", {"records": [record]}, "records")}
    assert set(rows) == {"deployment_evidence", "disclosed_equipment_quantity"}
    assert (rows["deployment_evidence"].value, rows["deployment_evidence"].unit, rows["deployment_evidence"].fact_class) == (1, "evidence_events", "evidence_event")
    assert (rows["disclosed_equipment_quantity"].value, rows["disclosed_equipment_quantity"].unit, rows["disclosed_equipment_quantity"].qualifier) == (4, "industrial_robots", "exact")
    assert rows["deployment_evidence"].dimensions["factory"] == "Plant A"


def test_feeds_fail_closed(spark):
    assert len(feeds.ADAPTERS) == 13
    with pytest.raises(KeyError):
        feeds.apply_adapter("none", spark.range(1))
    launches = spark.createDataFrame([("2026-01", None)], "month string, launch_count int")
    with pytest.raises(Exception, match="numeric"):
        feeds.apply_adapter("space_launches_monthly", launches).collect()
    with pytest.raises(ValueError, match="numeric"):
        feeds.apply_adapter("space_launches_monthly", launches.withColumn("launch_count", F.lit("7")))
    with pytest.raises(ValueError, match="lacks"):
        feeds.apply_adapter("space_launches_monthly", launches.drop("month").withColumn("launch_count", F.lit(7)))
    skipped = facts_by(spark, "bls_productivity", {"observations": [{"period": "2024Q1", "labor_productivity": 2.5, "unit_labor_costs": None}], "rate_basis": "saar"}, "observations")
    assert [(r.metric_id, r.value, r.entity, r.unit) for r in skipped] == [("labor_productivity", 2.5, "Nonfarm business", "percent_change_qoq_annualized")]
    treasury = {"entity": {"name": "S"}, "snapshots": [{"known_at": "2026-01-01", "trigger_event_id": "e", "state": {"bitcoin_holdings": {"value": 5, "unit": "BTC"}, "shares": {"value": 1, "unit": "x"}}}]}
    assert [(r.metric_id, r.value, r.entity, r.fact_class) for r in facts_by(spark, "bitcoin_treasury_snapshots", treasury, "snapshots")] == [("bitcoin_holdings", 5.0, "S", "state")]


def test_unknown_claim_rule(spark):
    series = spark.createDataFrame([("f", "m", "2026", 1.0, None, None)], "feed_id string, metric_id string, period string, value double, entity string, dimensions map<string,string>")
    claim = lambda rule: spark.createDataFrame([("c", rule, ["f"], ["m"], "gap")], "claim_id string, evaluation_rule string, source_feed_ids array<string>, measurement_variables array<string>, measurement_gap string")
    got = claims.evaluate_claims(claim("entity_trend_share"), series).first()
    assert (got.classification, got.thesis_state, got.evidence_row_count) == ("mixed", "mixed", 1)
    with pytest.raises(Exception, match="unknown evaluation rule"):
        claims.evaluate_claims(claim("invented"), series).collect()


def test_selection_and_gates(spark):
    m = dict(revenue_yoy=0.1, operating_income_yoy=0.1, net_income_yoy=0.1, operating_cf_yoy=0.1, per=9.0, fcf_yield=0.04, net_cash_ratio=0.0, pressure_signals=[("a",), ("b",)], negative_fundamental_events=[])
    cases = [m, m | dict(net_income_yoy=None), m | dict(per=10.5), m | dict(pressure_signals=[("a",), ("a",)]), m | dict(negative_fundamental_events=["loss"]), m | dict(pressure_signals=[])]
    schema = ", ".join(f"{k} double" for k in list(m)[:7]) + ", pressure_signals array<struct<type:string>>, negative_fundamental_events array<string>"
    got = facts.candidate_gates(spark.createDataFrame([tuple(c.values()) for c in cases], schema).coalesce(1)).collect()
    assert [(r.underlying_reality, r.price_pressure_mechanism, r.weak_case_margin) for r in got] == [("pass",) * 3, ("unknown", "pass", "pass"), ("pass", "pass", "fail"), ("pass", "fail", "pass"), ("pass", "fail", "pass"), ("pass", "unknown", "pass")]
    assert [r.eligible_for_decision_snapshot for r in got] == [True] + [False] * 5
    e = facts.entry_blockers(spark.createDataFrame([({"a": "pass", "b": "fail"},), ({"a": "pass"},)], "gates map<string,string>")).collect()
    assert [(x.blockers, x.eligible) for x in e] == [(["b"], False), ([], True)]
    rules = {
        "required_metadata": ["title", "abstract"], "score_weights": {"investment_relevance": 3, "method": 1}, "decision_thresholds": {"select": {f"min_{g}_terms": 1 for g in ("investment_relevance", "method", "empirical_or_data")}, "review": {"min_investment_relevance_terms": 1}},
        "term_groups": {"investment_relevance": ["portfolio", "trading strategy"], "method": ["model"], "empirical_or_data": ["data"], "pit_data": [], "oos": [], "transaction_cost": []},
    }
    text = ("Stock portfolio trading strategy", "We use price data to test a portfolio model.")
    papers = spark.createDataFrame([("2101.00002", *text), ("2101.00001", *text), ("3", "Portfolio", None), ("4", "Portfolio", "metadata only"), ("5", "x", "y")], "arxiv_id string, title string, abstract string")
    ranked = facts.ranked(facts.select_papers(papers.withColumn("citation_count", F.lit(9)), rules), "arxiv_id").collect()
    assert [(r.arxiv_id, r.decision, r.priority_score) for r in ranked] == [("2101.00001", "SELECT", 7), ("2101.00002", "SELECT", 7), ("4", "REVIEW", 3), ("3", "REJECT", 0), ("5", "REJECT", 0)]
    assert ranked[3].reason_codes == ["MISSING_REQUIRED_METADATA"] and ranked[3].evidence["missing_required_metadata"] == ["abstract"] and ranked[2].data_reproducibility == "UNKNOWN"
    cov = facts.coverage(spark.createDataFrame([("t",), ("u",)], "theme string"), spark.createDataFrame([("t", "c1"), ("t", "c2")], "theme string, component string"), spark.createDataFrame([("c1",)], "component string"))
    assert [(r.theme, r.covered) for r in cov.orderBy("theme").collect()] == [("t", False), ("u", False)]


def test_simulators_day_by_day(spark):
    """Against plain loops over days."""
    import random

    r = random.Random(3)
    signal, ret = [[r.choice((-1, 0, 1)) for _ in range(4)] for _ in range(40)], [[r.uniform(-3, 3) for _ in range(4)] for _ in range(40)]
    held, value, peak, worst, pnl, trades, wins = {}, 1.0, 1.0, 0.0, [], 0, 0
    for s, x in zip(signal, ret, strict=True):
        day, want = 0.0, {k: v for k, v in enumerate(s) if v}
        for k in [k for k, p in held.items() if want.get(k) != p[0]]:
            day -= 0.005 * held[k][1]
            trades, wins = trades + 1, wins + (held[k][2] > 0.005 * held[k][1])
            del held[k]
        for k, d in want.items():
            if k not in held:
                held[k] = [d, 0.3 / sum(v == d for v in want.values()), 0.0]
                day, trades = day - 0.005 * held[k][1], trades + 1
        for k, p in held.items():
            gain = p[1] * x[k] / 100 * p[0]
            day, p[2] = day + gain, p[2] + gain
        value *= 1 + day
        peak, worst = max(peak, value), max(worst, (max(peak, value) - value) / max(peak, value))
        pnl.append(day)
    wins += sum(p[2] > 0 for p in held.values())
    rows = [(t, k, signal[t][k], ret[t][k]) for t in range(40) for k in range(4)]
    got = portfolio.simulate_positions(spark.createDataFrame(rows, "t int, k int, s int, r double"), "k", "t", "s", "r").first()
    mean = sum(pnl) / 40
    sharpe = mean / math.sqrt(sum((p - mean) ** 2 for p in pnl) / 40) * math.sqrt(252)
    assert (got.num_trades, got.num_winning_trades) == (trades, wins) and math.isclose(got.total_returns_pct, (value - 1) * 100, abs_tol=1e-9) and math.isclose(got.sharpe_ratio, sharpe, rel_tol=1e-9) and math.isclose(got.max_drawdown_pct, worst * 100, rel_tol=1e-9)
    empty = portfolio.simulate_positions(spark.createDataFrame([], "t int, k int, s int, r double"), "k", "t", "s", "r").first()
    assert (empty.total_returns_pct, empty.sharpe_ratio, empty.num_trades, empty.win_rate) == (0.0, 0.0, 0, 0.0)
    bars = [("a", i, s, o) for i, (s, o) in enumerate([(1, 100.0), (1, 105.0), (-1, 110.0), (None, 1.0), (0, 100.0), (1, 50.0)])]
    one = portfolio.simulate_open_to_open(spark.createDataFrame(bars, "k string, t int, s int, o double"), ["k"], "t", "s", "o").first()
    want = ((1 + 0.1 - 0.005) * (1 + 0.1 - 0.005) - 1) * 100
    assert one.trades == 2 and math.isclose(one.total_return_pct, want, rel_tol=1e-9) and math.isclose(one.net_return_pct, want * 0.8, rel_tol=1e-9) and one.win_rate == 1.0 and one.proven


def test_paper_reward_checks(spark):
    l = F.lit
    reward = lambda a, s: spark.range(1).select(portfolio.paper_reward(l(a), l(0), l(0.1), l(s), l(0.2), l(2.0), l(10.0), l(0.01)).alias("r")).first().r
    assert math.isclose(reward(1, 0.2), 0.5 * 2 - 0.01 * 10 * 0.5)
    for bad in ((2, 0.2), (1, 0.0)):
        with pytest.raises(Exception, match="out of range"):
            reward(*bad)


def test_intervals_need_a_block(spark):
    m = spark.createDataFrame([(i, 0.01 * i) for i in range(5)], "m int, r double")
    with pytest.raises(Exception, match="fewer than a block"):
        stats.moving_block_ci(m, "m", "r").collect()
    a, b = (tuple(stats.bootstrap_ci(m.repartition(n), "r", 400).first()) for n in (1, 3))
    assert math.isclose(a[0], b[0], rel_tol=1e-12) and math.isclose(a[1], b[1], rel_tol=1e-12) and a[0] < 0.02 < a[1]
    with pytest.raises(Exception, match="variance"):
        stats.newey_west(m.withColumn("r", F.lit(1.0)).withColumn("k", F.lit(1)), ["k"], "m", "r", strict=True).collect()


def test_numeric(spark):
    mc = portfolio.monte_carlo_wealth(spark, 50_000, 104, 0.05, 0.2).first()
    assert abs(mc.mean - math.exp(0.05)) < 0.01
    m, v = portfolio.mean_variance_moments([0.1], [[0.04]], 2.0)
    assert math.isclose(m, 1 + (math.exp(0.25) - 1) / 4) and v > 0
    df = spark.createDataFrame([(i, float(i), float(-i), float(i % 3)) for i in range(30)], "d int, a double, b double, c double")
    p = portfolio.pca_factors(df, "d", ["a", "b", "c"]).orderBy("component").collect()
    assert p[0].eigenvalue > p[1].eigenvalue and p[0].loadings["a"] * p[0].loadings["b"] < 0
    assert stats.auc(spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1), (1, 0.5)], "y int, s double"), "y", "s").first().auc == 0.625
    c = stats.confusion(spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 0)], "y int, p int"), "y", "p").first()
    assert (c.accuracy, c.precision, c.recall, c.f1, c.mcc) == (0.5, 0.5, 0.5, 0.5, 0.0)
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert same.agg(stats.safe_corr("x", "y").alias("c")).first().c == 0


def test_stepwise_wealth(spark):
    """Weights are restored at each step: over equal assets, correlation decides the variance."""
    args = (spark, 40_000, 104, [0.05, 0.05], [0.2, 0.2])
    apart, alike = (portfolio.monte_carlo_wealth(*args, weights=[0.5, 0.5], corr=[[1, c], [c, 1]]).first() for c in (0.0, 0.999))
    assert abs(apart.mean - math.exp(0.05)) < 0.01 and apart.n == 40_000
    assert math.isclose(apart.variance, math.exp(0.1) * (math.exp(0.02) - 1), rel_tol=0.05) and math.isclose(alike.variance, math.exp(0.1) * (math.exp(0.04) - 1), rel_tol=0.05)


def test_reapplied_window(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    r, w, m = rng.normal(0, 0.01, (30, 3)), rng.normal(0, 1, (30, 3)), rng.normal(0, 0.01, 30)
    df = spark.createDataFrame([(t, a, float(w[t, a]), float(r[t, a]), float(m[t])) for t in range(30) for a in range(3)], "d int, a int, w double, r double, m double")
    got = {x.d: x for x in portfolio.reapplied_window(df, "d", "a", "w", "r", "m", 10).collect()}
    assert len(got) == 30 and (got[0].sigma, got[0].corr, got[1].corr) == (1e-8, 0, 0)
    for t in range(2, 30):
        p, b = r[max(0, t - 10) : t] @ w[t - 1], m[max(0, t - 10) : t]
        assert math.isclose(got[t].sigma, p.std(), rel_tol=1e-9) and math.isclose(got[t].corr, np.corrcoef(p, b)[0, 1], rel_tol=1e-9)


def test_significance(spark):
    df = spark.createDataFrame([(i % 2, i % 2 if i % 10 else 1 - i % 2) for i in range(200)], "y int, p int")
    got = {r.metric: r for r in stats.significance(df, "y", "p").collect()}
    assert len(got) == 5 and all(r.low < r.value < r.high or r.value == r.high == 1 for r in got.values()) and got["accuracy"].p_value == 1 / 10_001
    chance = spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(200)], "y int, p int")
    assert stats.significance(chance, "y", "p").first().p_value > 0.3


def test_registered_resamples(spark, monkeypatch):
    """The queries take the operators' numbers of resamples."""
    from marlstone.plans import queries

    seen = []
    monkeypatch.setattr(queries.stats, "moving_block_ci", lambda *a, **k: seen.append((len(a), k)))
    monkeypatch.setattr(queries.stats, "bootstrap_ci", lambda *a, **k: seen.append((len(a), k)))
    queries.bootstrap_ci(spark, "/root/testdata/sf0.001")
    queries.poisson_bootstrap(spark, "/root/testdata/sf0.001")
    assert seen == [(3, {}), (2, {})]


def test_many_terms_in_one_pass(spark):
    import re
    import time

    texts = ["Out-of-Sample  tests\tof momentum", "momentum and Momentum Factor", "a momentums factor_x", "cross-sectional momentum factor, t+1", "STRASSE Straße", "", None, "C++ is c", "x+ +x"]
    terms = ["momentum", "momentum factor", "factor", "Out-of-sample", "sample", "of", "t+1", "+1", "strasse", "c++", "c", "+x", "Momentum", "cross-sectional momentum", "none such"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: list(r.m) for r in df.select("i", S.matched_terms(F.col("t"), terms).alias("m")).collect()}
    flat = lambda t: " ".join(t.casefold().split())
    assert got == {i: sorted(w for w in terms if t is not None and re.search(rf"(?<!\w){re.escape(w.casefold())}(?!\w)", flat(t))) for i, t in enumerate(texts)}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)

    def took(n):
        start = time.perf_counter()
        docs.select(S.matched_terms(F.col("text"), [f"w{i} x{i}" for i in range(n)]).alias("m")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took(10)
    few, many = min(took(10) for _ in range(2)), min(took(10_000) for _ in range(2))
    assert many < 3 * few + 2


def test_pca_of_many_columns(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    columns = [f"c{i}" for i in range(120)]
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 120)) * 2 + rng.normal(size=(300, 120))
    x[:, 7] = 4.0  # no spread
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["d", *columns]).repartition(3)
    z = np.where(x.std(axis=0) > 0, (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0, ddof=1), 1), 0)
    values, vectors = np.linalg.eigh(0.9 * z.T @ z / len(z) + 0.1 * np.eye(120))
    for r in portfolio.pca_factors(df, "d", columns, 3).collect():
        v = np.array([r.loadings[c] for c in columns])
        assert math.isclose(r.eigenvalue, values[-1 - r.component], rel_tol=1e-9) and abs(abs(v @ vectors[:, -1 - r.component]) - 1) < 1e-9
        assert v[np.abs(v).argmax()] > 0 and math.isclose(r.explained, values[-1 - r.component] / values[-3:].sum(), rel_tol=1e-9)


def test_reapplied_window_with_gaps(spark):
    """Missing assets, weights, returns and market returns; a window longer than the series."""
    import numpy as np

    rng = np.random.default_rng(9)
    rows = [(t, a, None if rng.random() < 0.1 else float(rng.normal()), None if rng.random() < 0.1 else float(rng.normal(0, 0.01)), float(t % 5) / 100) for t in range(25) for a in range(4) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "d int, a int, w double, r double, m double")
    dates = sorted({r[0] for r in rows})
    w = {(t, a): x or 0.0 for t, a, x, _, _ in rows}
    ret = {(t, a): x or 0.0 for t, a, _, x, _ in rows}
    for window in (3, 100):
        got = {x.d: x for x in portfolio.reapplied_window(df, "d", "a", "w", "r", "m", window).collect()}
        for i, t in enumerate(dates):
            past = dates[max(0, i - window) : i]
            p = [sum(w.get((dates[i - 1], a), 0.0) * ret.get((s, a), 0.0) for a in range(4)) for s in past]
            want = max(1e-8, float(np.std(p))) if p else 1e-8
            assert math.isclose(got[t].sigma, want, rel_tol=1e-7)
            if len(p) > 2 and want > 1e-6:
                assert math.isclose(got[t].corr, np.corrcoef(p, [s % 5 / 100 for s in past])[0, 1], abs_tol=1e-7)
