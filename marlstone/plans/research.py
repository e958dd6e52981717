"""Registered queries of the research side: feeds, claims, papers, gates, simulators and audits, each with its DuckDB twin.

The inputs are made of the supplied tables, in the shape that each operator reads; the twins state the result in SQL from the definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import facts, feeds, quality, stats
from ..operators import relational as R
from ..session import table
from ..sources import rankindex, textindex
from .catalog import query
from .landing import landing
from .queries import n_, r6

text = lambda c: F.col(c).cast("string")
day = lambda c: F.date_format(c, "yyyy-MM-dd")


def bls(spark, sf):
    c = table(spark, sf, "customer").withColumn("v", F.col("c_acctbal") / 1000)
    quarter = lambda q, cost: F.struct(F.lit(q).alias("period"), F.col("v").alias("labor_productivity"), cost.alias("unit_labor_costs"))
    observed = F.array(quarter("2024-Q1", F.when(F.col("c_custkey") % 3 > 0, F.col("v") * 2)), quarter("2024-Q2", F.col("v") - 1))
    return feeds.records(c.select(F.col("c_mktsegment").alias("sector"), F.concat(F.lit("u/"), text("c_custkey")).alias("source_url"), F.lit("saar").alias("rate_basis"), observed.alias("observations")), "observations")


def capex(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "revenue").otherwise("capital_expenditures").alias("concept_id"), F.when(F.col("l_linestatus") == "F", "forecast").otherwise("actual").alias("value_type"), day("l_shipdate").alias("period_end"),
        F.when(F.col("l_linenumber") == 1, "annual").otherwise("quarter").alias("period_type"), F.col("l_extendedprice").alias("value"), F.lit("USD").alias("unit"), F.when(F.col("l_suppkey") % 2 == 0, "").otherwise(F.concat(F.lit("T"), text("l_suppkey"))).alias("ticker"),
        F.concat(F.lit("E"), text("l_suppkey")).alias("entity"), F.concat(F.lit("FY"), F.year("l_shipdate").cast("string")).alias("fiscal_period"), F.col("l_linenumber").alias("source_tier"),
    )


def consumer(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("metric"), day("ts").alias("as_of"), F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"), F.lit("users").alias("unit"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("provider"), F.col("event_type").alias("product"), F.when(F.col("value") > 50, "about").alias("qualifier"), F.date_format("ts", "yyyy-MM").alias("period"))


STATES = ("operating", "under_construction", "suspended_operation", "permanent_shutdown")


def nuclear(spark, sf):
    state = lambda i, s: F.struct(F.lit(s.replace("_", " ").title()).alias("status"), (F.col("n_nationkey") + i).alias("reactor_count"), (F.col("n_nationkey") * 100.5 + i).alias("net_electrical_capacity_mw")).alias(s)
    return table(spark, sf, "nation").select(F.lit("2026-01-01").alias("observed_at"), *(state(i, s) for i, s in enumerate(STATES)))


def vehicles(spark, sf):
    k = F.col("r_regionkey")
    dmv = F.struct(F.struct(F.lit("2024-11-30").alias("end")).alias("period"), (k * 1000.5).alias("autonomous_testing_miles"), (k * 3).alias("reported_disengagements"), (k + 2).alias("company_permit_group_count"), F.lit("not a rate").alias("metric_warning"), F.array(F.concat(F.lit("u"), text("r_regionkey")), F.lit("v")).alias("source_urls"))
    nhtsa = F.struct(F.struct(k.alias("report_count_2024_plus")).alias("ads"), F.struct((k + 9).alias("report_count_2024_plus")).alias("level_2_adas"), F.lit("page").alias("source_page"), F.lit("not normalized").alias("comparison_warning"))
    return table(spark, sf, "region").select(dmv.alias("california_dmv"), nhtsa.alias("nhtsa_sgo"))


def treasury(spark, sf):
    one = lambda v, u: F.struct(v.alias("value"), F.lit(u).alias("unit"), F.lit("filing").alias("source_url"), day("o_orderdate").alias("effective_at"))
    state = F.struct(one(F.col("o_totalprice") / 10, "BTC").alias("bitcoin_holdings"), F.when(F.col("o_orderstatus") != "P", one(F.col("o_totalprice"), "USD")).alias("usd_reserve"), one(F.lit(1.0), "x").alias("other"))
    return table(spark, sf, "orders").select(day("o_orderdate").alias("known_at"), state.alias("state"), text("o_orderkey").alias("trigger_event_id"))


def derivatives(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(day("ts").alias("date"), F.when(F.col("event_type") == "click", "PERPETUAL").otherwise("CURRENT_QUARTER").alias("contract_type"), F.concat(F.lit("S"), text("user_id")).alias("symbol"), (v / 10_000).alias("funding_rate_sum"), F.when(v >= 5, v / 10).alias("perpetual_premium_pct"), (v / 7).alias("annualized_delivery_basis_pct"))


def tokens(spark, sf):
    a = F.abs("s_acctbal")
    return table(spark, sf, "supplier").select(F.concat(F.lit("usd"), text("s_suppkey")).alias("asset_id"), F.concat(F.lit("2026-"), F.lpad((F.col("s_suppkey") % 12 + 1).cast("string"), 2, "0")).alias("as_of"), (a * 10).alias("circulation_usdc"), (a * 11).alias("reserve_fair_value_usd"), text("s_nationkey").alias("issuer_scope"))


def defi(spark, sf):
    n = lambda k, c: F.count_if(F.col("event_type") == k).alias(c)
    return table(spark, sf, "events").groupBy(day("ts").alias("date")).agg(n("click", "aave_event_count"), n("error", "aave_liquidation_count"), n("purchase", "uniswap_swap_count"))


def robots(spark, sf):
    measured = F.struct(F.lit("uptime").alias("name"), (F.col("p_size") * 1.5).alias("value"), F.lit("percent").alias("unit"), F.lit("mean").alias("qualifier"))
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("company"), F.concat(F.lit("F"), text("p_size")).alias("factory"), F.lit("JP").alias("country"), F.col("p_type").alias("deployment_stage"), F.lit("arm").alias("equipment_type"), F.when(F.col("p_size") > 25, "operational").otherwise("pilot").alias("status"),
        F.lit("2026-04-01").alias("observed_at"), F.concat(F.lit("u/"), text("p_partkey")).alias("source_url"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("quantity"), F.lit("robots").alias("quantity_unit"), F.lit("exact").alias("quantity_qualifier"), F.when(F.col("p_partkey") % 3 == 0, measured).alias("performance_metric"),
    )


def logistics(spark, sf):
    return table(spark, sf, "orders").select(day("o_orderdate").alias("effective_at"), F.concat(F.lit("op"), text("o_custkey")).alias("operator_id"), F.col("o_orderstatus").alias("event_type"), F.col("o_orderpriority").alias("mode"), F.when(F.col("o_totalprice") > 200_000, "Commercial service").otherwise("test").alias("operation_status"))


def launches(spark, sf):
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("launch_count"))


def holdings(spark, sf):
    r = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("w"))
    fund = F.struct(F.concat(F.lit("FUND"), text("n_regionkey")).alias("key"), F.struct(F.col("n").alias("row_count"), F.struct((F.col("w") / 3).alias("weight_total")).alias("audit"), F.lit("csv").alias("source_csv_url")).alias("value"))
    return r.agg(F.lit("08/21/2026").alias("as_of"), F.sum("n").alias("snapshot_count"), F.map_from_entries(F.collect_list(fund)).alias("funds"))


def _sql(metric, period, granularity, value, unit, fact_class="'observed'", entity="null", qualifier="null", url="null", dims="''", source=""):
    return f"select {metric} metric_id, {period} period, {granularity} period_granularity, cast({value} as double) as value, {unit} unit, {fact_class} fact_class, {entity} entity, {qualifier} qualifier, {url} source_url, {dims} dims from {source}"


def _nuclear_sql():
    out = []
    for i, s in enumerate(STATES):
        given = dict(period="'2026-01-01'", granularity="'snapshot'", entity="'Global nuclear fleet'", dims=f"'status={s.replace('_', ' ').title()}'", source="nation")
        out += [_sql("'reactor_count'", value=f"n_nationkey + {i}", unit="'reactors'", **given), _sql("'net_electrical_capacity'", value=f"n_nationkey * 100.5 + {i}", unit="'MW'", **given)]
    return " union all ".join(out)


def _vehicles_sql():
    own = dict(period="'2024-11-30'", granularity="'reporting_period_end'", entity="'California DMV autonomous testing'", url="'u' || r_regionkey", source="region")
    sgo = dict(period="'2024+'", granularity="'open_interval'", unit="'reports'", fact_class="'domain_derived'", url="'page'", dims="'warning=not normalized'", source="region")
    return " union all ".join((
        _sql("'autonomous_testing_miles'", value="r_regionkey * 1000.5", unit="'miles'", **own), _sql("'reported_disengagements'", value="r_regionkey * 3", unit="'events'", dims="'warning=not a rate'", **own), _sql("'permitted_company_groups'", value="r_regionkey + 2", unit="'company_groups'", **own),
        _sql("'sgo_report_count_2024_plus'", value="r_regionkey", entity="'ADS'", **sgo), _sql("'sgo_report_count_2024_plus'", value="r_regionkey + 9", entity="'Level 2 ADAS'", **sgo),
    ))


def _robots_sql():
    dims = "'country=JP;deployment_stage=' || p_type || ';equipment_type=arm;factory=F' || p_size || ';status=' || case when p_size > 25 then 'operational' else 'pilot' end"
    own = dict(period="'2026-04-01'", granularity="'event_date'", entity="p_brand", url="'u/' || p_partkey", dims=dims)
    return " union all ".join((
        _sql("'deployment_evidence'", value="1", unit="'evidence_events'", fact_class="'evidence_event'", source="part", **own), _sql("'disclosed_equipment_quantity'", value="p_size", unit="'robots'", qualifier="'exact'", source="part where p_partkey % 2 = 0", **own),
        _sql("'uptime'", value="p_size * 1.5", unit="'percent'", qualifier="'mean'", source="part where p_partkey % 3 = 0", **own),
    ))


_DAY = "strftime({}, '%Y-%m-%d')"
_D = _DAY.format("ts")
_DERIVATIVES = dict(period=_D, granularity="'day'", fact_class="'domain_derived'", entity="'S' || user_id")
_TREASURY = dict(period=_DAY.format("o_orderdate"), granularity="'known_at'", fact_class="'state'", entity="'Strategy Inc'", url="'filing'", dims=f"'effective_at=' || {_DAY.format('o_orderdate')} || ';trigger_event_id=' || o_orderkey")
_TOKENS = dict(period="'2026-' || lpad(cast(s_suppkey % 12 + 1 as varchar), 2, '0')", granularity="'as_of_date'", entity="'USD' || s_suppkey", dims="'issuer_scope=' || s_nationkey || ';report_published_at='", source="supplier")
_BLS = dict(granularity="'quarter'", unit="'percent_change_qoq_annualized'", entity="c_mktsegment", url="'u/' || c_custkey", dims="'rate_basis=saar'")
_FUNDS = "(select n_regionkey, count(*) n, sum(n_nationkey) w from nation group by 1)"

#: feed -> (adapter, its records, its facts in SQL).
FEEDS: dict[str, tuple[str, Callable, str]] = {
    "bls-productivity": ("bls_productivity", bls, " union all ".join((_sql("'labor_productivity'", "'2024-Q1'", value="c_acctbal / 1000", source="customer", **_BLS), _sql("'unit_labor_costs'", "'2024-Q1'", value="c_acctbal / 1000 * 2", source="customer where c_custkey % 3 > 0", **_BLS), _sql("'labor_productivity'", "'2024-Q2'", value="c_acctbal / 1000", source="customer", **_BLS), _sql("'unit_labor_costs'", "'2024-Q2'", value="c_acctbal / 1000 - 1", source="customer", **_BLS)))),
    "ai-infrastructure-capex": ("ai_infrastructure_capex", capex, _sql("'capital_expenditures'", _DAY.format("l_shipdate"), "case when l_linenumber = 1 then 'annual' else 'quarter' end", "l_extendedprice", "'USD'", entity="case when l_suppkey % 2 = 0 then 'E' else 'T' end || l_suppkey", dims="'fiscal_period=FY' || year(l_shipdate) || ';source_tier=' || l_linenumber", source="lineitem where l_returnflag <> 'R' and l_linestatus <> 'F'")),
    "ai-consumer-metrics": ("ai_consumer_metrics", consumer, _sql("event_type", _D, "'as_of_date'", "value", "'users'", entity="'p' || user_id % 5 || ' / ' || event_type", qualifier="case when value > 50 then 'about' end", dims="'geography=;reported_period=' || strftime(ts, '%Y-%m')", source="events where event_id % 7 > 0")),
    "nuclear-capacity": ("nuclear_capacity", nuclear, _nuclear_sql()),
    "autonomous-vehicles": ("autonomous_vehicles_summary", vehicles, _vehicles_sql()),
    "bitcoin-treasury": ("bitcoin_treasury_snapshots", treasury, " union all ".join((_sql("'bitcoin_holdings'", value="o_totalprice / 10", unit="'BTC'", source="orders", **_TREASURY), _sql("'usd_reserve'", value="o_totalprice", unit="'USD'", source="orders where o_orderstatus <> 'P'", **_TREASURY)))),
    "bitcoin-derivatives-daily": ("bitcoin_derivatives_daily", derivatives, " union all ".join((_sql("'funding_rate_sum'", value="value / 10000", unit="'rate_decimal'", dims="'contract_type=PERPETUAL'", source="events where event_type = 'click'", **_DERIVATIVES), _sql("'perpetual_premium_pct'", value="value / 10", unit="'percent'", dims="'contract_type=PERPETUAL'", source="events where event_type = 'click' and value >= 5", **_DERIVATIVES), _sql("'annualized_delivery_basis_pct'", value="value / 7", unit="'percent'", dims="'contract_type=CURRENT_QUARTER'", source="events where event_type <> 'click'", **_DERIVATIVES)))),
    "tokenized-assets": ("tokenized_assets_issuer", tokens, " union all ".join((_sql("'circulation_usdc'", value="abs(s_acctbal) * 10", unit="'USDC'", **_TOKENS), _sql("'reserve_fair_value_usd'", value="abs(s_acctbal) * 11", unit="'USD'", **_TOKENS)))),
    "defi-daily": ("defi_daily", defi, " union all ".join(_sql(f"'{m}'", _D, "'day'", f"count(*) filter (event_type = '{k}')", "'events'", "'domain_derived'", f"'{e}'", source="events group by 2") for m, k, e in (("aave_event_count", "click", "Aave V3"), ("aave_liquidation_count", "error", "Aave V3"), ("uniswap_swap_count", "purchase", "Uniswap V3")))),
    "robotics-deployments": ("robotics_deployments", robots, _robots_sql()),
    "autonomous-logistics": ("autonomous_logistics_events", logistics, _sql("'operation_evidence_event'", _DAY.format("o_orderdate"), "'event_date'", "1", "'evidence_events'", "'evidence_event'", "'op' || o_custkey", dims="'event_type=' || o_orderstatus || ';mode=' || o_orderpriority || ';operation_status=' || case when o_totalprice > 200000 then 'Commercial service' else 'test' end", source="orders")),
    "space-launches": ("space_launches_monthly", launches, _sql("'completed_launch_count'", "strftime(o_orderdate, '%Y-%m')", "'month'", "count(*)", "'launches'", "'domain_derived'", "'Tracked reusable-launch operators'", source="orders group by 2")),
    "ark-etf-holdings-latest": ("ark_etf_holdings_latest", holdings, " union all ".join((_sql("'snapshot_count'", "'2026-08-21'", "'as_of_date'", "count(*)", "'snapshots'", "'audit'", "'ARK ETF holdings archive'", source="nation"), _sql("'holding_row_count'", "'2026-08-21'", "'as_of_date'", "n", "'holdings'", "'audit'", "'FUND' || n_regionkey", url="'csv'", source=_FUNDS), _sql("'portfolio_weight_total'", "'2026-08-21'", "'as_of_date'", "w / 3.0", "'percent'", "'audit'", "'FUND' || n_regionkey", url="'csv'", source=_FUNDS)))),
}


def _adapted(spark, sf, feed: str) -> DataFrame:
    name, records, _ = FEEDS[feed]
    return feeds.apply_adapter(name, records(spark, sf))


def _dims(c: str):
    pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(pairs, ";"), F.lit(""))


def _register_feeds():
    for feed, (name, _, sql) in FEEDS.items():

        def run(spark, sf, feed=feed):
            out = _adapted(spark, sf, feed)
            return out.select(*(c for c in out.columns if c not in ("dimensions", "value")), r6(F.col("value"), "value"), _dims("dimensions").alias("dims"))

        query(f"feed_{name}", f"select * replace (round(value, 6) as value) from ({sql})")(run)


_register_feeds()


def series(spark, sf) -> DataFrame:
    return feeds.projection({feed: _adapted(spark, sf, feed) for feed in FEEDS})


SERIES = "series as (" + " union all ".join(f"select '{feed}' feed_id, metric_id, period, value, entity, dims from ({sql})" for feed, (_, _, sql) in FEEDS.items()) + ")"
#: claim, rule, feeds, metrics.
CLAIMS = (
    ("c00", "deferred", ["defi-daily"], ["aave_event_count"]), ("c01", "cross_theme_coverage", ["defi-daily", "space-launches", "ark-etf-holdings-latest"], ["aave_event_count", "completed_launch_count", "snapshot_count"]),
    ("c02", "entity_trend_share", ["ai-infrastructure-capex"], ["capital_expenditures"]), ("c03", "consumer_scale_evidence", ["ai-consumer-metrics"], ["click", "view"]), ("c04", "latest_productivity_direction", ["bls-productivity"], ["labor_productivity", "unit_labor_costs"]),
    ("c05", "bitcoin_partial", ["bitcoin-treasury", "bitcoin-derivatives-daily"], ["bitcoin_holdings", "funding_rate_sum"]), ("c06", "issuer_supply_trend", ["tokenized-assets"], ["circulation_usdc"]), ("c07", "recent_vs_early_activity", ["defi-daily"], ["aave_event_count"]),
    ("c08", "launch_cadence_trend", ["space-launches"], ["completed_launch_count"]), ("c09", "robotics_deployment_evidence", ["robotics-deployments"], ["deployment_evidence", "uptime"]), ("c10", "distributed_energy_partial", ["nuclear-capacity"], ["net_electrical_capacity"]),
    ("c11", "autonomous_vehicle_evidence", ["autonomous-vehicles"], ["autonomous_testing_miles", "permitted_company_groups"]), ("c12", "autonomous_logistics_commercial", ["autonomous-logistics"], ["operation_evidence_event"]), ("c13", "robotics_deployment_evidence", ["robotics-deployments"], ["uptime"]),
    ("c14", "entity_trend_share", ["nowhere"], ["nothing"]), ("c15", "cross_theme_coverage", ["defi-daily", "space-launches"], ["aave_event_count", "completed_launch_count"]),
)


def claim_table(spark):
    return spark.createDataFrame([(*c, "gap") for c in CLAIMS], "claim_id string, evaluation_rule string, source_feed_ids array<string>, measurement_variables array<string>, measurement_gap string")


_CLAIMS = "claims as (select * from (values " + ", ".join(f"('{i}', '{r}', {f}, {m})" for i, r, f, m in CLAIMS) + ") t(claim_id, rule, feeds, metrics))"
_ORDER = "period, feed_id, metric_id, entity, value"
_CLASS = """case when rule = 'deferred' then 'deferred' when n is null then 'unresolved'
 when rule = 'cross_theme_coverage' then case when n_feeds >= 3 then 'mixed' else 'unresolved' end
 when rule = 'entity_trend_share' then case when share >= 0.6 then 'directionally_supporting' else 'mixed' end
 when rule in ('consumer_scale_evidence', 'bitcoin_partial', 'distributed_energy_partial') then 'mixed'
 when rule = 'latest_productivity_direction' then case when productivity is null then 'unresolved' when productivity > 0 then 'directionally_supporting' else 'mixed' end
 when rule = 'issuer_supply_trend' then case when n_supply >= 2 and supply_z > supply_a then 'directionally_supporting' else 'mixed' end
 when rule in ('recent_vs_early_activity', 'launch_cadence_trend') then case when recent > early then 'directionally_supporting' else 'mixed' end
 when rule = 'robotics_deployment_evidence' then case when deployed > 0 then 'mixed' else 'unresolved' end
 when rule = 'autonomous_vehicle_evidence' then case when n_vehicle > 0 then 'mixed' else 'unresolved' end
 when rule = 'autonomous_logistics_commercial' then case when commercial > 0 then 'directionally_supporting' else 'mixed' end end"""


@query(
    "claim_evaluation",
    f"""with {SERIES}, {_CLAIMS},
    sel as (select c.claim_id, c.rule, s.*, row_number() over (partition by claim_id order by {_ORDER}) i, count(*) over (partition by claim_id) all_n from claims c join series s on list_contains(c.feeds, s.feed_id) and list_contains(c.metrics, s.metric_id)),
    ends as (select *, least(case when rule = 'recent_vs_early_activity' then 7 else 6 end, greatest(1, all_n // 2)) k from sel where rule in ('recent_vs_early_activity', 'launch_cadence_trend')),
    em as (select claim_id, avg(value) filter (i <= k) early, avg(value) filter (i > all_n - k) recent from ends group by 1),
    ent as (select claim_id, first(value order by {_ORDER}) a, last(value order by {_ORDER}) z from sel where rule = 'entity_trend_share' group by claim_id, entity having count(*) >= 2),
    es as (select claim_id, avg(case when z > a then 1.0 else 0.0 end) share, count(*) entities from ent group by 1),
    g as (select claim_id, count(*) n, count(distinct feed_id) n_feeds, last(value order by {_ORDER}) filter (metric_id = 'labor_productivity') productivity, count(*) filter (metric_id = 'circulation_usdc') n_supply,
      first(value order by {_ORDER}) filter (metric_id = 'circulation_usdc') supply_a, last(value order by {_ORDER}) filter (metric_id = 'circulation_usdc') supply_z, first(value order by {_ORDER}) filter (metric_id = 'bitcoin_holdings') held_a, last(value order by {_ORDER}) filter (metric_id = 'bitcoin_holdings') held_z,
      count(*) filter (metric_id = 'deployment_evidence') deployed, count(*) filter (metric_id in ('autonomous_testing_miles', 'permitted_company_groups')) n_vehicle, count(*) filter (contains(lower(dims), 'commercial')) commercial,
      count(*) filter (metric_id = 'net_electrical_capacity' and contains(lower(dims), 'construction')) building, min(period) p0, max(period) p1 from sel group by 1),
    j as (select c.claim_id, c.rule, n, n_feeds, productivity, n_supply, supply_a, supply_z, held_a, held_z, deployed, n_vehicle, commercial, building, p0, p1, early, recent, share, entities from claims c left join g using (claim_id) left join em using (claim_id) left join es using (claim_id))
    select claim_id, rule evaluation_rule, case when rule = 'deferred' then 0 else coalesce(n, 0) end evidence_row_count, {_CLASS} classification,
      case {_CLASS} when 'directionally_supporting' then 'strengthening' when 'mixed' then 'mixed' when 'unresolved' then 'insufficient_evidence' else 'deferred' end thesis_state, round(share, 4) share_increasing, entities entities_compared, round(early, 6) early_mean, round(recent, 6) recent_mean,
      round(productivity, 6) productivity, round(held_a, 6) holdings_first, round(held_z, 6) holdings_last, round(supply_a, 6) supply_first, round(supply_z, 6) supply_last, deployed deployment_events, building under_construction_rows, commercial commercial_events, p0 first_period, p1 latest_period from j""",
)
def claim_evaluation(spark, sf):
    out = C.evaluate_claims(claim_table(spark), series(spark, sf))
    whole = ("claim_id", "evaluation_rule", "evidence_row_count", "classification", "thesis_state", "share_increasing", "entities_compared", "deployment_events", "under_construction_rows", "commercial_events", "first_period", "latest_period")
    return out.select(*whole, *(r6(F.col(c), c) for c in ("early_mean", "recent_mean", "productivity", "holdings_first", "holdings_last", "supply_first", "supply_last")))


@query(
    "claim_observations",
    f"""with {SERIES}, {_CLAIMS}, sel as (select c.claim_id, c.rule, s.* from claims c join series s on list_contains(c.feeds, s.feed_id) and list_contains(c.metrics, s.metric_id)),
    ent as (select claim_id, entity e, first(value order by {_ORDER}) a, last(value order by {_ORDER}) z, min((period, feed_id, metric_id, entity, value)) o from sel where rule = 'entity_trend_share' group by 1, 2 having count(*) >= 2),
    comp as (select *, row_number() over (partition by claim_id order by o) i from ent), late as (select *, row_number() over (partition by claim_id order by period desc, feed_id desc, metric_id desc, entity desc, value desc) k from sel where rule = 'consumer_scale_evidence'),
    st as (select claim_id, regexp_extract(dims, '(^|;)status=([^;]*)', 2) e, count(*) n from sel where rule = 'robotics_deployment_evidence' and metric_id = 'deployment_evidence' group by 1, 2),
    one as (select claim_id, rule, metric_id, first(value order by {_ORDER}) a, last(value order by {_ORDER}) z, count(*) n from sel where rule in ('latest_productivity_direction', 'bitcoin_partial', 'issuer_supply_trend', 'autonomous_vehicle_evidence') group by 1, 2, 3)
    select claim_id, 'comparison' kind, i::int place, e as name, cast(z > a as bigint) n, round(a, 6) "first", round(z, 6) "last", null period from comp where i <= 10
    union all select claim_id, 'latest_observation', (least(8, (select count(*) from late)) + 1 - k)::int, metric_id, null, null, round(value, 6), period from late where k <= 8
    union all select claim_id, 'status', (row_number() over (partition by claim_id order by e))::int, e, n, null, null, null from st
    union all select claim_id, 'under_construction_capacity', null, metric_id, null, null, round(value, 6), period from sel where rule = 'distributed_energy_partial' and metric_id = 'net_electrical_capacity' and contains(lower(dims), 'construction')
    union all select claim_id, 'deployment_metric', (row_number() over (partition by claim_id order by metric_id))::int, metric_id, null, null, round(z, 6), null from one where metric_id in ('autonomous_testing_miles', 'permitted_company_groups')
    union all select claim_id, 'latest_labor_productivity', null, metric_id, null, null, round(z, 6), null from one where rule = 'latest_productivity_direction' and metric_id = 'labor_productivity'
    union all select claim_id, k, null, metric_id, null, null, round(case when k = 'treasury_first' then a else z end, 6), null from one, (values ('treasury_first'), ('treasury_latest')) t(k) where rule = 'bitcoin_partial' and metric_id = 'bitcoin_holdings'
    union all select claim_id, k, null, metric_id, null, null, round(case when k = 'first' then a else z end, 6), null from one, (values ('first'), ('latest')) t(k) where rule = 'issuer_supply_trend' and metric_id = 'circulation_usdc' and n >= 2""",
)
def claim_observations(spark, sf):
    """What the rules show; of a listed fact its period, taken from its reference."""
    out = C.claim_observations(claim_table(spark), series(spark, sf))
    period = F.when(F.col("kind").isin("latest_observation", "under_construction_capacity"), F.get_json_object("ref", "$.period"))
    return out.select("claim_id", "kind", "place", "name", "n", r6(F.col("first"), "first"), r6(F.col("last"), "last"), period.alias("period"))


@query("fact_selection", f"with {SERIES} select feed_id, metric_id, period, round(value, 6) as value from series where feed_id in ('defi-daily', 'space-launches') and metric_id in ('aave_event_count', 'completed_launch_count')")
def fact_selection(spark, sf):
    return facts.select_facts(series(spark, sf), ["defi-daily", "space-launches"], ["aave_event_count", "completed_launch_count"]).select("feed_id", "metric_id", "period", r6(F.col("value"), "value"))


@query("evidence_refs", f"with {SERIES} select metric_id, entity, case when entity is null then 0 else 1 end has_entity, cast(count(*) as bigint) n from series where feed_id = 'defi-daily' group by 1, 2, 3")
def evidence_refs(spark, sf):
    e = R.evidence_ref(series(spark, sf).filter("feed_id = 'defi-daily'"), ["feed_id", "metric_id", "period", "value", "unit", "entity", "fact_class", "source_url", "dimensions"])
    e = e.select(F.get_json_object("evidence", "$.metric_id").alias("metric_id"), F.get_json_object("evidence", "$.entity").alias("entity"), F.get_json_object("evidence", "$.source_url").isNotNull().alias("u"))
    return e.groupBy("metric_id", "entity", F.col("entity").isNotNull().cast("int").alias("has_entity")).agg(n_())


@query("fund_links", f"with {SERIES} select 'FUND' || r_regionkey fund, 'alpha' || chr(44) || 'beta' claim_themes, round(max(value) filter (metric_id = 'holding_row_count'), 6) holding_row_count, round(max(value) filter (metric_id = 'portfolio_weight_total'), 6) portfolio_weight_total from region left join series on entity = 'FUND' || r_regionkey and feed_id = 'ark-etf-holdings-latest' group by 1")
def fund_links(spark, sf):
    funds = table(spark, sf, "region").select(F.concat(F.lit("FUND"), text("r_regionkey")).alias("fund"), F.lit("holds").alias("relation"), F.array(F.lit("c00"), F.lit("c01")).alias("claim_ids"))
    out = C.fund_links(funds, spark.createDataFrame([("c00", "alpha"), ("c01", "beta")], "claim_id string, theme string"), series(spark, sf))
    return out.select("fund", F.array_join("claim_themes", ",").alias("claim_themes"), r6(F.col("holding_row_count"), "holding_row_count"), r6(F.col("portfolio_weight_total"), "portfolio_weight_total"))


def sources_of(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_name").alias("logical_repo"), F.when(F.col("n_nationkey") % 3 == 0, "deferred_by_user").otherwise("ready").alias("status"), F.concat(F.lit("o/"), F.col("n_name")).alias("current_repo"))


def feeds_of(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey % 4 <> 1")
    return n.select(F.col("n_name").alias("logical_repo"), F.concat(F.lit("f"), (F.col("n_nationkey") % 20).cast("string")).alias("feed_id"), F.lit("defi_daily").alias("adapter"), F.col("n_regionkey").alias("row_count"), F.concat(F.when(F.col("n_nationkey") == 2, "x/").otherwise("o/"), F.col("n_name")).alias("repository"), F.when(F.col("n_nationkey") == 6, "ftp://h").otherwise("https://raw.githubusercontent.com/o").alias("raw_url"))


@query("feed_matrix", "select n_name logical_repo, f.n_nationkey is null excluded, case when f.n_nationkey is null then case when n.n_nationkey % 3 = 0 then 'deferred_by_user' else 'ready' end end reason, f.n_regionkey row_count from nation n left join (select * from nation where n_nationkey % 4 <> 1) f using (n_name)")
def feed_matrix(spark, sf):
    return feeds.feed_matrix(sources_of(spark, sf), feeds_of(spark, sf)).select("logical_repo", "excluded", "reason", "row_count")


@query(
    "catalog_drift",
    """select 'missing_feed' as rule, n_name as key from nation where n_nationkey % 3 > 0 and n_nationkey % 4 = 1 union all select 'extra_feed', n_name from nation where n_nationkey % 3 = 0 and n_nationkey % 4 <> 1
    union all select 'repository_drift', n_name from nation where n_nationkey = 2 union all select 'foreign_url', n_name from nation where n_nationkey = 6
    union all select 'duplicate_feed', 'f' || n_nationkey % 20 from nation where n_nationkey % 4 <> 1 group by 2 having count(*) > 1""",
)
def catalog_drift(spark, sf):
    return feeds.catalog_drift(sources_of(spark, sf), feeds_of(spark, sf))


#: Terms that part names and types hold, in the groups of a selector's rules.
PAPER_RULES = {
    "required_metadata": ["title", "abstract", "categories"], "score_weights": {"investment_relevance": 3, "method": 2, "empirical_or_data": 1, "oos": 5},
    "decision_thresholds": {"select": {"min_investment_relevance_terms": 1, "min_method_terms": 1, "min_empirical_or_data_terms": 1}, "review": {"min_investment_relevance_terms": 1}},
    "term_groups": {"investment_relevance": ["widget", "ring"], "method": ["red", "small"], "empirical_or_data": ["economy", "data"], "pit_data": ["blue"], "oos": ["promo"], "transaction_cost": ["large"]},
}
_HAS = lambda t: f"cast(regexp_matches(lower(tt), '(^|\\W){t}(\\W|$)') as int)"
_GROUP = {g: " + ".join(map(_HAS, ts)) for g, ts in PAPER_RULES["term_groups"].items()}


@query(
    "paper_selection",
    f"""with p as (select p_partkey, p_name title, case when p_partkey % 11 > 0 then p_type || ' metadata' end abstract, p_partkey % 13 > 0 cat from part), t as (select *, title || ' ' || coalesce(abstract, '') tt, abstract is null or not cat missing from p),
    g as (select *, {", ".join(f"{e} n_{g}" for g, e in _GROUP.items())} from t)
    select p_partkey, case when missing then 'REJECT' when n_investment_relevance > 0 and n_method > 0 and n_empirical_or_data > 0 then 'SELECT' when n_investment_relevance > 0 then 'REVIEW' else 'REJECT' end decision,
    case when missing then 0 else 3 * n_investment_relevance + 2 * n_method + n_empirical_or_data + 5 * n_oos end priority_score,
    case when missing then 'MISSING_REQUIRED_METADATA' when n_investment_relevance > 0 and n_method > 0 and n_empirical_or_data > 0 then 'STRONG_METADATA_EVIDENCE_FOR_PAPER_INSPECTION' when n_investment_relevance > 0 then 'INSUFFICIENT_METADATA_EVIDENCE_FOR_AUTOMATIC_PROMOTION' else 'NO_INVESTMENT_RELEVANCE_EVIDENCE' end reason,
    case when n_method > 0 then 'METADATA_CUE' else 'UNKNOWN' end method_clarity, case when n_pit_data > 0 then 'METADATA_CUE' else 'UNKNOWN' end pit_data_feasibility, cast(missing as int) + {" + ".join(f"cast(n_{g} > 0 as int)" for g in _GROUP)} n_evidence from g""",
)
def paper_selection(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 11 > 0, F.concat("p_type", F.lit(" metadata"))).alias("abstract"), F.when(F.col("p_partkey") % 13 > 0, F.array(F.lit("q-fin.PM"))).otherwise(F.array().cast("array<string>")).alias("categories"))
    return facts.select_papers(p, PAPER_RULES).select("p_partkey", "decision", "priority_score", F.col("reason_codes")[0].alias("reason"), "method_clarity", "pit_data_feasibility", F.size("evidence").alias("n_evidence"))


@query("paper_ranking", "select p_partkey, case when p_size > 30 then 'SELECT' when p_size > 15 then 'REVIEW' else 'REJECT' end decision from part order by case when p_size > 30 then 0 when p_size > 15 then 1 else 2 end, p_size % 7 desc, p_partkey limit 40")
def paper_ranking(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 30, "SELECT").when(F.col("p_size") > 15, "REVIEW").otherwise("REJECT").alias("decision"), (F.col("p_size") % 7).alias("priority_score"))
    return facts.ranked(p, "p_partkey").select("p_partkey", "decision").limit(40)


def candidates(spark, sf):
    signal = lambda k: F.struct(F.lit(k).alias("type"))
    k, a = F.col("c_custkey"), F.col("c_acctbal")
    signals = F.when(k % 5 == 0, F.array().cast("array<struct<type:string>>")).when(k % 5 == 1, F.array(signal("x"), signal("x"))).otherwise(F.array(signal("x"), signal("y")))
    return table(spark, sf, "customer").select(
        "c_custkey", a.alias("revenue_yoy"), (a + 500).alias("operating_income_yoy"), F.when(k % 7 > 0, a + 900).alias("net_income_yoy"), F.lit(1.0).alias("operating_cf_yoy"), (k % 20).cast("double").alias("per"), ((k % 10) / 100).alias("fcf_yield"),
        F.when(k % 9 > 0, a).alias("net_cash_ratio"), signals.alias("pressure_signals"), F.when(k % 6 == 0, F.array(F.lit("loss"))).otherwise(F.array().cast("array<string>")).alias("negative_fundamental_events"),
    )


@query(
    "candidate_gates",
    """with g as (select c_custkey, case when c_custkey % 7 = 0 then 'unknown' when c_acctbal > 0 then 'pass' else 'fail' end reality, case when c_custkey % 5 > 1 and c_custkey % 6 > 0 then 'pass' when c_custkey % 5 = 0 then 'unknown' else 'fail' end pressure,
    case when c_custkey % 9 = 0 then 'unknown' when c_custkey % 20 <= 10 and c_custkey % 10 >= 3 and c_acctbal >= 0 then 'pass' else 'fail' end margin from customer)
    select c_custkey, reality underlying_reality, pressure price_pressure_mechanism, margin weak_case_margin, reality = 'pass' and pressure = 'pass' and margin = 'pass' eligible_for_decision_snapshot from g""",
)
def candidate_gates(spark, sf):
    return facts.candidate_gates(candidates(spark, sf)).select("c_custkey", "underlying_reality", "price_pressure_mechanism", "weak_case_margin", "eligible_for_decision_snapshot")


@query(
    "entry_blockers",
    """with g as (select c_custkey, case when c_custkey % 7 = 0 then 'unknown' when c_acctbal > 0 then 'pass' else 'fail' end reality, case when c_custkey % 5 > 1 and c_custkey % 6 > 0 then 'pass' when c_custkey % 5 = 0 then 'unknown' else 'fail' end pressure from customer)
    select c_custkey, concat_ws(',', case when pressure <> 'pass' then 'pressure' end, case when reality <> 'pass' then 'reality' end) blockers, pressure = 'pass' and reality = 'pass' eligible from g""",
)
def entry_blockers(spark, sf):
    g = facts.candidate_gates(candidates(spark, sf)).withColumn("gates", F.create_map(F.lit("reality"), F.col("underlying_reality"), F.lit("pressure"), F.col("price_pressure_mechanism")))
    return facts.entry_blockers(g).select("c_custkey", F.array_join("blockers", ",").alias("blockers"), "eligible")


@query("quality_scores", "select c_custkey, round(c_acctbal / 1000 * (c_nationkey + 1), 6) quality, round(c_acctbal * (1 + 10 * (c_nationkey / 25.0) - 0.1 * (c_custkey % 3)), 6) swarm from customer order by abs(c_acctbal) desc, c_custkey limit 10")
def quality_scores(spark, sf):
    c = facts.top(table(spark, sf, "customer"), F.col("c_acctbal"), ["c_custkey"], 10, absolute=True)
    return c.select("c_custkey", r6(facts.quality_score(F.col("c_acctbal") / 1000, F.col("c_nationkey") + 1), "quality"), r6(facts.swarm_score(F.col("c_acctbal"), F.col("c_nationkey") / 25, F.col("c_custkey") % 3), "swarm"))


@query("theme_coverage", "select r_name theme, cast(count(n_nationkey) as bigint) components, coalesce(bool_and(n_nationkey % 4 > 0), false) covered from region left join nation on n_regionkey = r_regionkey and r_regionkey <> 2 group by 1")
def theme_coverage(spark, sf):
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    c = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).filter("r_regionkey <> 2").select(F.col("r_name").alias("theme"), F.col("n_name").alias("component"))
    return facts.coverage(r.select(F.col("r_name").alias("theme")), c, n.filter("n_nationkey % 4 > 0").select(F.col("n_name").alias("component"))).select("theme", "components", "covered")


@query("source_evidence", "select c_custkey, o_orderkey is null as excluded, case when o_orderkey is null then c_mktsegment end reason, o_orderkey from customer left join (select o_custkey, max(o_orderkey) o_orderkey from orders where o_orderstatus = 'P' group by 1) on c_custkey = o_custkey")
def source_evidence(spark, sf):
    e = table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return facts.with_evidence(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("status")), e, "c_custkey").select("c_custkey", "excluded", "reason", F.col("evidence.o_orderkey").alias("o_orderkey"))


@query("forecast_view", "select r_name theme, n_nationkey y2030 from region left join nation on n_regionkey = r_regionkey and n_nationkey % 2 = 0")
def forecast_view(spark, sf):
    r = table(spark, sf, "region")
    f = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("theme"), F.col("n_nationkey").alias("y2030"))
    return facts.forecast_view(r.select(F.col("r_name").alias("theme")), f, ["y2030"])


@query("pinned_inputs", "select case when o_orderstatus = 'F' and o_orderkey % 5 > 0 then 'record' else 'blocked' end kind, cast(count(*) as bigint) n from (select * from customer where c_acctbal > 5000) left join (select * from orders where o_orderkey < 1000) on c_custkey = o_orderkey group by 1")
def pinned_inputs(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("arxiv_id"))
    o = table(spark, sf, "orders").filter("o_orderkey < 1000").select(F.col("o_orderkey").alias("arxiv_id"), F.when(F.col("o_orderstatus") == "F", "VERIFIED").otherwise("UNKNOWN").alias("availability_status"), F.when(F.col("o_orderkey") % 5 > 0, "v1").otherwise("").alias("selected_version"))
    records, blocked = quality.pinned_inputs(c, o, ["selected_version"])
    return records.select(F.lit("record").alias("kind")).unionByName(blocked.select(F.lit("blocked").alias("kind"))).groupBy("kind").agg(n_())


@query("verdict_stability", "with v as (select c_nationkey, c_mktsegment, count(*) n from customer where c_acctbal > 9500 group by 1, 2) select c_nationkey, cast(sum(n) as bigint) runs, count(*) = 1 verdict_stable, string_agg(c_mktsegment || '=' || n, ',' order by c_mktsegment) counts from v group by 1")
def verdict_stability(spark, sf):
    v = stats.verdict_stability(table(spark, sf, "customer").filter("c_acctbal > 9500"), ["c_nationkey"], "c_mktsegment")
    return v.select("c_nationkey", "runs", "verdict_stable", F.array_join(F.transform(F.array_sort(F.map_entries("verdict_counts")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counts"))


@query("best_restart", "select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) r from customer) where r = 1")
def best_restart(spark, sf):
    return stats.best_restart(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", "c_custkey").select("c_nationkey", "c_custkey", "c_acctbal")


@query("table_stats", "select o_orderstatus, cast(count(*) as bigint) as rows, min(o_orderdate) first_date, max(o_orderdate) last_date from orders group by 1")
def table_stats(spark, sf):
    return R.table_stats(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderdate")


@query("plot_window", "select y, round(v, 2) v from (select year(o_orderdate) y, case when year(o_orderdate) <> 1997 then sum(o_totalprice) end v from orders group by 1) where y <= 1999 and v is not null")
def plot_window(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s")).select("y", F.when(F.col("y") != 1997, F.col("s")).alias("v"))
    return R.plot_window(y, "y", 1999, "v").select("y", F.round("v", 2).alias("v"))


@query("locale_order", "select n_name, n_nationkey from nation where n_nationkey in (select n_nationkey from nation order by lower(n_name), n_nationkey limit 7)")
def locale_order(spark, sf):
    return R.locale_order(table(spark, sf, "nation").select("n_name", "n_nationkey"), "n_name", "n_nationkey").limit(7)


@query("ordered_distinct", "with o as (select o_custkey, list(o_orderstatus order by o_orderdate, o_orderkey) s from orders group by 1) select o_custkey, s[1] as first_status, cast(len(list_distinct(s)) as int) n from o")
def ordered_distinct(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("s"))
    return s.select("o_custkey", F.element_at(R.distinct_in_order("s"), 1).alias("first_status"), F.size(R.distinct_in_order("s")).alias("n"))


@query("keyword_or_member", "select p_partkey from part where p_brand in ('Brand#1', 'Brand#2') or contains(p_name, 'ring')")
def keyword_or_member(spark, sf):
    return table(spark, sf, "part").filter(R.keyword_or_member(F.col("p_brand"), ["Brand#1", "Brand#2"], F.col("p_name"), "ring")).select("p_partkey")


@query("search_page", "(select c_custkey, 'found' kind from customer where contains(c_name, 'BUILD') or contains(lower(c_mktsegment), 'build') order by c_custkey limit 100) union all (select c_custkey, 'all' from customer order by c_custkey limit 100)")
def search_page(spark, sf):
    index = textindex.build(table(spark, sf, "customer"), ["c_name", "c_mktsegment"], landing(spark))
    page = lambda q, kind: R.search_page(index, q, ["c_name"], ["c_mktsegment"], [F.col("c_custkey")]).select("c_custkey", F.lit(kind).alias("kind"))
    return page("BUILD", "found").unionByName(page("", "all"))


@query("indexed_search", "select doc_id, 'text' as kind from documents where contains(text, 'password') or contains(lower(text), 'licensed under') union all select doc_id, 'source' from documents where source ilike '%s_t%'")
def indexed_search(spark, sf):
    """Two searches in one stored index of whole texts: a literal in the texts, and a LIKE pattern of the sources."""
    docs = table(spark, sf, "documents").repartitionByRange("doc_id")
    index = textindex.build(docs.select("doc_id", "text", "source"), ["text", "source"], landing(spark), block_rows=64, row_group=1 << 18)
    found = index.search("password", ["text"]).unionByName(index.search("licensed under", folded=["text"])).distinct().select("doc_id", F.lit("text").alias("kind"))
    return found.unionByName(index.ilike("source", "%s_t%").select("doc_id", F.lit("source").alias("kind")))


@query(
    "deep_page",
    "with t as (select l_orderkey, l_linenumber, l_shipdate, row_number() over (order by l_shipdate, l_orderkey, l_linenumber) i, count(*) over () n from lineitem) select l_orderkey, l_linenumber, l_shipdate from t where (i - 1) // 50 in ((n - 1) // 50, n // 200)",
)
def deep_page(spark, sf):
    """The last page of the line items by date, and one of the middle, by an index of ranks."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    index = rankindex.build(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], landing(spark), 256)
    return index.page(index.pages()).unionByName(index.page(index.rows // 200 + 1))
