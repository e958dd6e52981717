"""Selection and gates over research records: facts by feed and metric, candidate gates, paper selection, coverage, forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def select_facts(facts: DataFrame, feeds: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return facts.filter(F.col("feed_id").isin(list(feeds)) & F.col("metric_id").isin(list(metrics)))


def three_valued(*values: Column) -> Column:
    """unknown if any is null, pass if all are above 0, else fail."""
    return F.when(reduce(lambda a, b: a | b, (v.isNull() for v in values)), "unknown").when(reduce(lambda a, b: a & b, (v > 0 for v in values)), "pass").otherwise("fail")


GROWTH = ("revenue_yoy", "operating_income_yoy", "net_income_yoy", "operating_cf_yoy")
#: Margin of a weak case: price to earnings at most, yield of the free cash flow and net cash at least.
MOST_PER, LEAST_FCF_YIELD, LEAST_NET_CASH = 10.0, 0.03, 0.0


def candidate_gates(df: DataFrame, growth: Sequence[str] = GROWTH, signals: str = "pressure_signals", events: str = "negative_fundamental_events", least_signals: int = 2) -> DataFrame:
    """underlying_reality, price_pressure_mechanism, weak_case_margin (pass, fail or unknown) and eligible_for_decision_snapshot.

    signals: array of structs with a type; events: array of negative fundamental events; null arrays are empty. Also read: per, fcf_yield, net_cash_ratio.
    Pressure passes with enough different types and no negative event, and is unknown without signals.
    """
    kinds = F.coalesce(F.size(F.array_distinct(F.transform(signals, lambda s: s["type"]))), F.lit(0))
    n, bad = F.coalesce(F.size(signals), F.lit(0)), F.coalesce(F.size(events), F.lit(0))
    pressure = F.when((kinds >= least_signals) & (bad <= 0), "pass").when(n <= 0, "unknown").otherwise("fail")
    per, fcf, cash = F.col("per"), F.col("fcf_yield"), F.col("net_cash_ratio")
    margin = F.when(per.isNull() | fcf.isNull() | cash.isNull(), "unknown").when((per <= MOST_PER) & (fcf >= LEAST_FCF_YIELD) & (cash >= LEAST_NET_CASH), "pass").otherwise("fail")
    df = df.withColumns({"underlying_reality": three_valued(*map(F.col, growth)), "price_pressure_mechanism": pressure, "weak_case_margin": margin})
    return df.withColumn("eligible_for_decision_snapshot", (F.col("underlying_reality") == "pass") & (F.col("price_pressure_mechanism") == "pass") & (F.col("weak_case_margin") == "pass"))


def entry_blockers(df: DataFrame, gates: str = "gates") -> DataFrame:
    """The names of the gates (a map of name to state) that don't pass, and whether there are none."""
    names = F.transform(F.filter(F.map_entries(gates), lambda e: ~e["value"].eqNullSafe(F.lit("pass"))), lambda e: e["key"])
    df = df.withColumn("blockers", F.array_sort(names))
    return df.withColumn("eligible", F.size("blockers") == 0)


def quality_score(eps_growth: Column, bps: Column) -> Column:
    return eps_growth * bps


def swarm_score(macro: Column, micro: Column, risk: Column) -> Column:
    return macro * (1 + 10 * micro - 0.1 * risk)


def top(df: DataFrame, score: Column, ties: Sequence[str], k: int = 10, absolute: bool = False) -> DataFrame:
    """The k rows of the largest (absolute) score, in a total order."""
    return df.orderBy((F.abs(score) if absolute else score).desc(), *ties).limit(k)


#: Statuses of a paper and the group of terms that gives the cue for each.
DIMENSIONS = {"investment_relevance": "investment_relevance", "method_clarity": "method", "data_reproducibility": "empirical_or_data", "pit_data_feasibility": "pit_data", "oos_testability": "oos", "transaction_cost_testability": "transaction_cost"}


def select_papers(df: DataFrame, rules: dict) -> DataFrame:
    """decision, priority_score, reason_codes, evidence (group -> matched terms) and a status for each of DIMENSIONS.

    rules: required_metadata (columns), term_groups (group -> terms), decision_thresholds (select: least numbers of terms of investment_relevance, method and
    empirical_or_data; review: of investment_relevance) and score_weights (group -> weight). Terms match as whole words of title and abstract, without regard to case and white
    space. Missing metadata (null, '' or []) rejects with score 0 and is itself evidence. No other column is read.
    """
    text = F.concat_ws(" ", "title", "abstract")
    groups = {g: S.matched_terms(text, list(terms)) for g, terms in sorted(rules["term_groups"].items())}
    empty = lambda c: F.size(c) <= 0 if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string") == ""
    lacks = [F.when(F.col(c).isNull() | F.coalesce(empty(c), F.lit(True)), F.lit(c)) if c in df.columns else F.lit(c) for c in sorted(rules["required_metadata"])]
    df = df.withColumns({f"__{g}": m for g, m in groups.items()}).withColumn("__missing", F.array_compact(F.array(*lacks)))
    n = lambda g: F.size(f"__{g}")
    missing = F.size("__missing") > 0
    select, review = rules["decision_thresholds"]["select"], rules["decision_thresholds"]["review"]
    strong = reduce(lambda a, b: a & b, (n(g) >= select[f"min_{g}_terms"] for g in ("investment_relevance", "method", "empirical_or_data")))
    some = n("investment_relevance") >= review["min_investment_relevance_terms"]
    decision = F.when(missing, "REJECT").when(strong, "SELECT").when(some, "REVIEW").otherwise("REJECT")
    reason = F.when(missing, "MISSING_REQUIRED_METADATA").when(strong, "STRONG_METADATA_EVIDENCE_FOR_PAPER_INSPECTION").when(some, "INSUFFICIENT_METADATA_EVIDENCE_FOR_AUTOMATIC_PROMOTION").otherwise("NO_INVESTMENT_RELEVANCE_EVIDENCE")
    score = F.when(missing, 0).otherwise(reduce(lambda a, b: a + b, (F.lit(w) * n(g) for g, w in sorted(rules["score_weights"].items()))))
    every = {**{g: F.col(f"__{g}") for g in groups}, "missing_required_metadata": F.col("__missing")}
    evidence = F.map_filter(F.create_map(*(x for g, c in every.items() for x in (F.lit(g), c))), lambda k, v: F.size(v) > 0)
    out = df.withColumns({"decision": decision, "priority_score": score.cast("int"), "reason_codes": F.array(reason), "evidence": evidence})
    out = out.withColumns({d: F.when(n(g) > 0, "METADATA_CUE").otherwise("UNKNOWN") for d, g in DIMENSIONS.items() if g in groups})
    return out.drop("__missing", *(f"__{g}" for g in groups))


def ranked(df: DataFrame, ident: str) -> DataFrame:
    rank = F.when(F.col("decision") == "SELECT", 0).when(F.col("decision") == "REVIEW", 1).otherwise(2)
    return df.orderBy(rank, F.col("priority_score").desc(), ident)


def coverage(themes: DataFrame, components: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether every component of each theme has a source; themes without components are not covered."""
    have = components.join(sources.select("component").distinct().withColumn("__s", F.lit(True)), "component", "left")
    all_ = have.groupBy("theme").agg(F.bool_and(F.coalesce("__s", F.lit(False))).alias("covered"), F.count("*").alias("components"))
    return themes.join(all_, "theme", "left").na.fill(0, ["components"]).withColumn("covered", F.coalesce("covered", F.lit(False)))


def with_evidence(sources: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Each source with its evidence, or excluded with its status as the reason."""
    e = evidence.select(key, F.struct(*[c for c in evidence.columns if c != key]).alias("evidence"))
    out = sources.join(e, key, "left")
    return out.withColumns({"excluded": F.col("evidence").isNull(), "reason": F.when(F.col("evidence").isNull(), F.col("status"))})


def forecast_view(themes: DataFrame, forecasts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All themes in order, with their forecasts where there are any."""
    return themes.join(forecasts.select("theme", *columns), "theme", "left").orderBy("theme", *columns[:1])
