"""Claims against measured facts: each claim names its feeds, its metrics and a rule, and gets one of four classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import keep_row

SUPPORTING, MIXED, UNRESOLVED, DEFERRED = "directionally_supporting", "mixed", "unresolved", "deferred"
#: What a class says about the thesis.
THESIS = {SUPPORTING: "strengthening", MIXED: "mixed", UNRESOLVED: "insufficient_evidence", DEFERRED: "deferred"}
#: Rows at either end that the rules on activity compare, at most.
ENDS = {"recent_vs_early_activity": 7, "launch_cadence_trend": 6}
#: Least share of entities with an increase, and feeds of a cross-theme claim.
SHARE, FEEDS = 0.6, 3
RULES = (
    "deferred", "cross_theme_coverage", "entity_trend_share", "consumer_scale_evidence", "latest_productivity_direction", "bitcoin_partial", "issuer_supply_trend", "recent_vs_early_activity",
    "launch_cadence_trend", "robotics_deployment_evidence", "distributed_energy_partial", "autonomous_vehicle_evidence", "autonomous_logistics_commercial",
)


def claim_facts(claims: DataFrame, series: DataFrame) -> DataFrame:
    """The facts of each claim: those of its feeds and metrics, by an equi-join of what its two lists hold."""
    wanted = claims.select("claim_id", "evaluation_rule", F.explode(F.array_distinct("source_feed_ids")).alias("feed_id"), "measurement_variables").select("claim_id", "evaluation_rule", "feed_id", F.explode(F.array_distinct("measurement_variables")).alias("metric_id"))
    return series.join(wanted, ["feed_id", "metric_id"])


def _ends(rows: DataFrame) -> DataFrame:
    """(claim_id, ends, early_mean, recent_mean) of the rules on activity; either end is pruned to its few rows in the map tasks."""
    rows = rows.filter(F.col("evaluation_rule").isin(*ENDS)).select("claim_id", "evaluation_rule", "o", "value")
    most = F.when(F.col("evaluation_rule") == "recent_vs_early_activity", 7).otherwise(6)
    n = rows.groupBy("claim_id", "evaluation_rule").agg(F.count("*").alias("n")).select("claim_id", F.least(most, F.greatest(F.lit(1), F.floor(F.col("n") / 2))).cast("int").alias("ends"))
    out = n
    for name, order in (("early_mean", F.col("o").asc()), ("recent_mean", F.col("o").desc())):
        few = keep_row(rows, ["claim_id"], [order], max(ENDS.values()))
        place = F.row_number().over(Window.partitionBy("claim_id").orderBy(order))
        out = out.join(few.withColumn("k", place).join(n, "claim_id").filter("k <= ends").groupBy("claim_id").agg(F.avg("value").alias(name)), "claim_id", "left")
    return out


def _entities(rows: DataFrame) -> DataFrame:
    """(claim_id, entities_compared, share_increasing): first and last value of each entity with at least two facts."""
    rows = rows.filter("evaluation_rule = 'entity_trend_share'")
    each = rows.groupBy("claim_id", F.coalesce("entity", F.lit("unknown")).alias("e")).agg(F.min_by("value", "o").alias("a"), F.max_by("value", "o").alias("z"), F.count("*").alias("n")).filter("n >= 2")
    return each.groupBy("claim_id").agg(F.count("*").alias("entities_compared"), F.avg((F.col("z") > F.col("a")).cast("double")).alias("share_increasing"))


def evaluate_claims(claims: DataFrame, series: DataFrame) -> DataFrame:
    """One row per claim: claim_id, evaluation_rule, evidence_row_count, classification, thesis_state, measurement_gap and the figures that its rule looks at.

    claims: claim_id, evaluation_rule, source_feed_ids, measurement_variables, measurement_gap. series: facts with feed_id. Facts are ordered by period, then by feed, metric,
    entity and value. A deferred claim is not looked at, a claim without facts is unresolved; an unknown rule stops the run. All rules are evaluated in one aggregate
    over the claims' facts, beside two small ones for entities and for the ends of a series.
    """
    rows = claim_facts(claims, series).withColumn("o", F.struct("period", "feed_id", "metric_id", F.coalesce("entity", F.lit("")), "value")).select("claim_id", "evaluation_rule", "feed_id", "metric_id", "period", "value", "entity", "dimensions", "o")
    of = lambda m: F.col("metric_id") == m
    first = lambda m: F.min_by(F.when(of(m), F.col("value")), F.when(of(m), F.col("o")))
    last = lambda m: F.max_by(F.when(of(m), F.col("value")), F.when(of(m), F.col("o")))
    status, words = F.lower(F.coalesce(F.col("dimensions")["status"], F.lit(""))), F.lower(F.array_join(F.map_values("dimensions"), " "))
    seen = rows.groupBy("claim_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("feed_id")).alias("covered_feeds"), last("labor_productivity").alias("productivity"),
        first("bitcoin_holdings").alias("holdings_first"), last("bitcoin_holdings").alias("holdings_last"), F.count_if(F.col("feed_id") == "bitcoin-derivatives-daily").alias("derivatives_rows"),
        F.count_if(of("circulation_usdc")).alias("supply_rows"), first("circulation_usdc").alias("supply_first"), last("circulation_usdc").alias("supply_last"), F.count_if(of("deployment_evidence")).alias("deployment_events"),
        F.count_if(of("net_electrical_capacity") & F.contains(status, F.lit("construction"))).alias("under_construction_rows"), F.count_if(F.col("metric_id").isin("autonomous_testing_miles", "permitted_company_groups")).alias("vehicle_rows"),
        F.count_if(F.coalesce(F.contains(words, F.lit("commercial")), F.lit(False))).alias("commercial_events"), F.min("period").alias("first_period"), F.max("period").alias("latest_period"),
    )
    out = claims.select("claim_id", "evaluation_rule", "measurement_gap").join(seen, "claim_id", "left").join(_entities(rows), "claim_id", "left").join(_ends(rows), "claim_id", "left")
    return out.select(
        "claim_id", "evaluation_rule", F.when(F.col("evaluation_rule") == DEFERRED, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("evidence_row_count"), _class().alias("classification"),
        F.create_map(*(F.lit(x) for kv in THESIS.items() for x in kv))[_class()].alias("thesis_state"), "measurement_gap", F.round("share_increasing", 4).alias("share_increasing"), "entities_compared", "ends", "early_mean", "recent_mean",
        "productivity", "holdings_first", "holdings_last", "derivatives_rows", "supply_first", "supply_last", "deployment_events", "under_construction_rows", "commercial_events", "covered_feeds", "first_period", "latest_period",
    )


def _class() -> Column:
    """The class by each rule, in the order of RULES; without facts none applies but deferral."""
    yes = lambda ok, no=MIXED: F.when(ok, SUPPORTING).otherwise(no)
    any_ = lambda ok: F.when(ok, MIXED).otherwise(UNRESOLVED)
    rising = yes(F.coalesce(F.col("recent_mean") > F.col("early_mean"), F.lit(False)))
    by = {
        "cross_theme_coverage": any_(F.size("covered_feeds") >= FEEDS), "entity_trend_share": yes(F.coalesce(F.col("share_increasing") >= SHARE, F.lit(False))), "consumer_scale_evidence": F.lit(MIXED),
        "latest_productivity_direction": F.when(F.col("productivity").isNull(), UNRESOLVED).otherwise(yes(F.col("productivity") > 0)), "bitcoin_partial": F.lit(MIXED),
        "issuer_supply_trend": yes((F.col("supply_rows") >= 2) & (F.col("supply_last") > F.col("supply_first"))), "recent_vs_early_activity": rising, "launch_cadence_trend": rising,
        "robotics_deployment_evidence": any_(F.col("deployment_events") > 0), "distributed_energy_partial": F.lit(MIXED), "autonomous_vehicle_evidence": any_(F.col("vehicle_rows") > 0), "autonomous_logistics_commercial": yes(F.col("commercial_events") > 0),
    }
    rule = F.col("evaluation_rule")
    out = F.raise_error(F.concat(F.lit("unknown evaluation rule: "), rule)).cast("string")
    for name, says in by.items():
        out = F.when(rule == name, says).otherwise(out)
    known = rule.isin(*RULES)
    return F.when(rule == DEFERRED, DEFERRED).when(known & F.col("n").isNull(), UNRESOLVED).otherwise(out)


#: What a fact that is shown as evidence tells, where it has it.
REF = ("feed_id", "logical_repo", "metric_id", "period", "value", "unit", "entity", "fact_class", "mirror_snapshot_id", "mirror_sha256", "source_url", "dimensions")
#: Latest facts and compared entities that are shown.
LATEST, COMPARISONS = 8, 10
#: The single facts that rules show: (rule, kind, metric or None for any, first or last).
_SINGLE = (
    ("latest_productivity_direction", "latest_labor_productivity", "labor_productivity", False), ("bitcoin_partial", "treasury_first", "bitcoin_holdings", True), ("bitcoin_partial", "treasury_latest", "bitcoin_holdings", False),
    ("issuer_supply_trend", "first", "circulation_usdc", True), ("issuer_supply_trend", "latest", "circulation_usdc", False),
)


def claim_observations(claims: DataFrame, series: DataFrame) -> DataFrame:
    """What each claim's rule shows, as rows: (claim_id, kind, place, name, n, first, last, ref), ref being the fact as JSON of those of REF that it has.

    `comparison`: entities with at least two facts, their first and last value, n 1 if it rose, the COMPARISONS whose first fact comes first. `latest_observation`: the LATEST last facts,
    in order. `status`: events by status. `under_construction_capacity`: such facts. `deployment_metric`: the last fact of each metric. And first and last facts of holdings, supply
    and productivity; supply of fewer than two facts shows none. Facts are ordered as in evaluate_claims; deferred claims and claims without facts show nothing.
    Every kind keeps or counts rows with an aggregate or a pruned rank, and all but the facts under construction are bounded for each claim and entity, status or metric.
    """
    shown = F.to_json(F.struct(*(c for c in REF if c in series.columns)), {"ignoreNullFields": "true"})
    rows = claim_facts(claims, series.withColumn("__ref", shown)).withColumn("o", F.struct("period", "feed_id", "metric_id", F.coalesce("entity", F.lit("")), "value"))
    rows = rows.select("claim_id", "evaluation_rule", "metric_id", "value", "entity", "dimensions", F.col("__ref").alias("ref"), "o")
    of = lambda rule: rows.filter(F.col("evaluation_rule") == rule)
    none = lambda kind: F.lit(None).cast(kind)

    def out(df, kind, place, name=None, n=None, first=None, last=None, ref=None):
        cells = (("place", place, "int"), ("name", name, "string"), ("n", n, "long"), ("first", first, "double"), ("last", last, "double"), ("ref", ref, "string"))
        return df.select("claim_id", kind.alias("kind"), *((none(t) if c is None else c.cast(t)).alias(x) for x, c, t in cells))

    place = lambda *by: F.row_number().over(Window.partitionBy("claim_id").orderBy(*by))
    each = of("entity_trend_share").groupBy("claim_id", F.coalesce("entity", F.lit("unknown")).alias("e")).agg(F.min("o").alias("a"), F.max("o").alias("z"), F.count("*").alias("n")).filter("n >= 2")
    compared = keep_row(each, ["claim_id"], [F.col("a")], COMPARISONS)
    parts = [out(compared, F.lit("comparison"), place("a"), F.col("e"), (F.col("z.value") > F.col("a.value")).cast("int"), F.col("a.value"), F.col("z.value"))]
    few = keep_row(of("consumer_scale_evidence"), ["claim_id"], [F.col("o").desc()], LATEST)
    parts.append(out(few, F.lit("latest_observation"), place("o"), F.col("metric_id"), last=F.col("value"), ref=F.col("ref")))
    status = of("robotics_deployment_evidence").filter("metric_id = 'deployment_evidence'").groupBy("claim_id", F.coalesce(F.col("dimensions")["status"], F.lit("unknown")).alias("e")).agg(F.count("*").alias("n"))
    parts.append(out(status, F.lit("status"), place("e"), F.col("e"), F.col("n")))
    building = of("distributed_energy_partial").filter((F.col("metric_id") == "net_electrical_capacity") & F.contains(F.lower(F.coalesce(F.col("dimensions")["status"], F.lit(""))), F.lit("construction")))
    parts.append(out(building, F.lit("under_construction_capacity"), None, F.col("metric_id"), last=F.col("value"), ref=F.col("ref")))
    vehicles = of("autonomous_vehicle_evidence").filter(F.col("metric_id").isin("autonomous_testing_miles", "permitted_company_groups")).groupBy("claim_id", "metric_id").agg(F.max_by(F.struct("value", "ref"), "o").alias("x"))
    parts.append(out(vehicles, F.lit("deployment_metric"), place("metric_id"), F.col("metric_id"), last=F.col("x.value"), ref=F.col("x.ref")))
    single = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), F.lit(first).alias("first")) for rule, kind, metric, first in _SINGLE))
    ends = rows.withColumn("s", F.explode(F.filter(single, lambda x: (x["rule"] == F.col("evaluation_rule")) & (x["metric"] == F.col("metric_id")))))
    ends = ends.groupBy("claim_id", "evaluation_rule", "s.kind", "s.first").agg(F.min_by(F.struct("metric_id", "value", "ref"), "o").alias("a"), F.max_by(F.struct("metric_id", "value", "ref"), "o").alias("z"), F.count("*").alias("n"))
    ends = ends.filter("evaluation_rule <> 'issuer_supply_trend' OR n >= 2").withColumn("x", F.when(F.col("first"), F.col("a")).otherwise(F.col("z")))
    parts.append(out(ends, F.col("kind"), None, F.col("x.metric_id"), last=F.col("x.value"), ref=F.col("x.ref")))
    return reduce(DataFrame.unionByName, parts)


def fund_links(funds: DataFrame, claims: DataFrame, series: DataFrame, feed: str = "ark-etf-holdings-latest") -> DataFrame:
    """Each fund (fund, relation, claim_ids) with its claims' themes and the audited figures of its holdings, if there are any."""
    claim = funds.select("fund", F.posexplode("claim_ids").alias("i", "claim_id")).join(claims.select("claim_id", "theme"), "claim_id", "left")
    themes = claim.groupBy("fund").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "theme"))), lambda x: x["theme"]).alias("claim_themes"))
    held = series.filter(F.col("feed_id") == feed).groupBy(F.col("entity").alias("fund")).agg(F.max(F.when(F.col("metric_id") == "holding_row_count", F.col("value"))).alias("holding_row_count"), F.max(F.when(F.col("metric_id") == "portfolio_weight_total", F.col("value"))).alias("portfolio_weight_total"))
    return funds.join(themes, "fund", "left").join(held, "fund", "left")
