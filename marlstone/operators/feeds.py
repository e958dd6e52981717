"""Feed adapters: records of a domain feed as metric facts, one row for each measured value.

An adapter takes one row for each record, with the payload's own fields as further columns (records() makes them of payloads
with an array), and looks a field up by name, so that columns that a feed doesn't have are null. Facts are structs of one
pass over the records; nothing is derived or filled in. A value that must be there and is null, or isn't numeric, stops the run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a fact and their types.
FACT = {
    "metric_id": "string", "period": "string", "period_granularity": "string", "value": "double", "unit": "string", "fact_class": "string",
    "entity": "string", "qualifier": "string", "source_url": "string", "dimensions": "map<string,string>",
}
FACT_COLUMNS = tuple(FACT)

#: name -> function of a feed's records to facts.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(f: Callable[[DataFrame], DataFrame]):
    ADAPTERS[f.__name__] = f
    return f


def records(payloads: DataFrame, array: str = "records") -> DataFrame:
    """One row for each element of the payloads' array, with its fields and those of the payload that it doesn't have itself."""
    element = payloads.schema[array].dataType.elementType
    own = [f.name for f in element.fields]
    rows = payloads.select(*(c for c in payloads.columns if c != array and c not in own), F.explode(array).alias("__r"))
    return rows.select(*(c for c in rows.columns if c != "__r"), "__r.*")


class Fields:
    """A frame's columns by dotted path, through structs and maps."""

    def __init__(self, df: DataFrame):
        self.schema = df.schema

    def kind(self, path: str) -> T.DataType | None:
        """Type of what the path leads to, or None."""
        at: T.DataType | None = self.schema
        for name in path.split("."):
            if isinstance(at, T.MapType):
                at = at.valueType
            else:
                at = at[name].dataType if isinstance(at, T.StructType) and name in at.names else None
        return at

    def __call__(self, path: str, default: str | None = None) -> Column:
        """As text; null, or the default, where the feed has no such field. A default doesn't replace a null that is there."""
        return F.lit(default).cast("string") if self.kind(path) is None else F.col(path).cast("string")

    def need(self, path: str) -> Column:
        if self.kind(path) is None:
            raise ValueError(f"feed lacks {path}")
        return F.col(path).cast("string")

    def number(self, path: str) -> Column:
        """A value that must be numeric and not null."""
        if not isinstance(self.kind(path), T.NumericType):
            raise ValueError(f"metric must be numeric: {path}")
        return F.coalesce(F.col(path).cast("double"), F.raise_error(F.lit(f"metric must be numeric: {path}")).cast("double"))

    def number_if_any(self, path: str) -> Column:
        """A value, or null where there is none or it isn't numeric."""
        return F.col(path).cast("double") if isinstance(self.kind(path), T.NumericType) else F.lit(None).cast("double")


def fact(metric_id, period, granularity, value, unit, entity=None, qualifier=None, source_url=None, dimensions: dict | None = None, fact_class="observed", when: Column | None = None) -> Column:
    """A fact as a struct, null unless `when` holds. Texts are literals, columns are taken as they are."""
    given = dict(metric_id=metric_id, period=period, period_granularity=granularity, value=value, unit=unit, fact_class=fact_class, entity=entity, qualifier=qualifier, source_url=source_url)
    given["dimensions"] = F.create_map(*(x for k, v in dimensions.items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(v)).cast("string")))) if dimensions else None
    one = F.struct(*((given[n] if isinstance(given[n], Column) else F.lit(given[n])).cast(kind).alias(n) for n, kind in FACT.items()))
    return one if when is None else F.when(when, one)


def facts_of(df: DataFrame, *facts: Column) -> DataFrame:
    """Rows of the facts that are there, by one explode."""
    return df.select(F.explode(F.array_compact(F.array(*facts))).alias("__f")).select("__f.*")


@adapter
def bls_productivity(df):
    """Quarterly changes of labor productivity and unit labor costs; quarters without a figure give none."""
    f = Fields(df)
    given = dict(period=f.need("period"), granularity="quarter", unit="percent_change_qoq_annualized", entity=f("sector", "Nonfarm business"), source_url=f("source_url"), dimensions={"rate_basis": f("rate_basis")})
    return facts_of(df, *(fact(m, value=(v := f.number_if_any(m)), when=v.isNotNull(), **given) for m in ("labor_productivity", "unit_labor_costs")))


@adapter
def ai_infrastructure_capex(df):
    """Actual capital expenditures; other concepts and forecasts are left out."""
    f = Fields(df)
    df = df.filter((f("concept_id") == "capital_expenditures") & (f("value_type") == "actual"))
    entity = F.coalesce(F.nullif(f("ticker"), F.lit("")), f.need("entity"))
    return facts_of(df, fact("capital_expenditures", f.need("period_end"), f("period_type", "quarter"), f.number("value"), f.need("unit"), entity, source_url=f("source_url"), dimensions={"fiscal_period": f("fiscal_period"), "source_tier": f("source_tier")}))


@adapter
def ai_consumer_metrics(df):
    """Every record with a number, under the metric that it names."""
    f = Fields(df)
    value = f.number_if_any("value")
    entity = F.concat(f.need("provider"), F.lit(" / "), f.need("product"))
    return facts_of(df, fact(f.need("metric"), f.need("as_of"), "as_of_date", value, f.need("unit"), entity, f("qualifier"), f("source_url"), {"geography": f("geography"), "reported_period": f("period")}, when=value.isNotNull()))


@adapter
def nuclear_capacity(df):
    """Reactors and net capacity of the four states of the fleet, for each payload."""
    f, out = Fields(df), []
    for state in ("operating", "under_construction", "suspended_operation", "permanent_shutdown"):
        given = dict(period=f.need("observed_at"), granularity="snapshot", entity="Global nuclear fleet", dimensions={"status": f.need(f"{state}.status")})
        out += [fact("reactor_count", value=f.number(f"{state}.reactor_count"), unit="reactors", **given), fact("net_electrical_capacity", value=f.number(f"{state}.net_electrical_capacity_mw"), unit="MW", **given)]
    return facts_of(df, *out)


@adapter
def autonomous_vehicles_summary(df):
    """Testing miles, disengagements and permits, and report counts by kind of system, for each payload. No rate is made of them."""
    f = Fields(df)
    given = dict(period=f.need("california_dmv.period.end"), granularity="reporting_period_end", entity="California DMV autonomous testing", source_url=F.col("california_dmv.source_urls")[0])
    out = [
        fact("autonomous_testing_miles", value=f.number("california_dmv.autonomous_testing_miles"), unit="miles", **given),
        fact("reported_disengagements", value=f.number("california_dmv.reported_disengagements"), unit="events", dimensions={"warning": f.need("california_dmv.metric_warning")}, **given),
        fact("permitted_company_groups", value=f.number("california_dmv.company_permit_group_count"), unit="company_groups", **given),
    ]
    for system, label in (("ads", "ADS"), ("level_2_adas", "Level 2 ADAS")):
        value = f.number(f"nhtsa_sgo.{system}.report_count_2024_plus")
        out.append(fact("sgo_report_count_2024_plus", "2024+", "open_interval", value, "reports", label, source_url=f.need("nhtsa_sgo.source_page"), dimensions={"warning": f.need("nhtsa_sgo.comparison_warning")}, fact_class="domain_derived"))
    return facts_of(df, *out)


@adapter
def bitcoin_treasury_snapshots(df):
    """The known state of a treasury at each snapshot: of its named facts (a struct or map in `state`) these five."""
    f, out = Fields(df), []
    names = ("bitcoin_holdings", "bitcoin_aggregate_purchase_price_usd", "convertible_notes_principal_outstanding_usd", "preferred_stock_notional_outstanding_usd", "usd_reserve")
    for m in names:
        if f.kind(f"state.{m}") is not None:
            has = F.col(f"state.{m}").isNotNull()
            given = dict(entity=f("entity.name", "Strategy Inc"), source_url=f(f"state.{m}.source_url"), dimensions={"effective_at": f(f"state.{m}.effective_at"), "trigger_event_id": f("trigger_event_id")})
            out.append(fact(m, f.need("known_at"), "known_at", f.number(f"state.{m}.value"), f.need(f"state.{m}.unit"), fact_class="state", when=has, **given))
    return facts_of(df, *out) if out else df.limit(0).select(*(F.lit(None).cast(k).alias(n) for n, k in FACT.items()))


@adapter
def bitcoin_derivatives_daily(df):
    """Funding and premium of perpetual contracts; the basis of the others. The two kinds are never mixed."""
    f = Fields(df)
    perpetual = f.need("contract_type") == "PERPETUAL"
    given = dict(period=f.need("date"), granularity="day", entity=f.need("symbol"), fact_class="domain_derived", dimensions={"contract_type": f.need("contract_type")})
    metrics = (("funding_rate_sum", "rate_decimal", perpetual), ("perpetual_premium_pct", "percent", perpetual), ("annualized_delivery_basis_pct", "percent", ~perpetual))
    return facts_of(df, *(fact(m, value=(v := f.number_if_any(m)), unit=u, when=kind & v.isNotNull(), **given) for m, u, kind in metrics))


@adapter
def tokenized_assets_issuer(df):
    """Circulation and the fair value of the reserve, as reported by the issuer."""
    f = Fields(df)
    given = dict(period=f.need("as_of"), granularity="as_of_date", entity=F.upper(f.need("asset_id")), source_url=f("source_url"), dimensions={"issuer_scope": f("issuer_scope"), "report_published_at": f("report_published_at")})
    return facts_of(df, *(fact(m, value=f.number(m), unit=u, **given) for m, u in (("circulation_usdc", "USDC"), ("reserve_fair_value_usd", "USD"))))


@adapter
def defi_daily(df):
    """Daily numbers of events of two protocols."""
    f = Fields(df)
    metrics = (("aave_event_count", "Aave V3"), ("aave_liquidation_count", "Aave V3"), ("uniswap_swap_count", "Uniswap V3"))
    return facts_of(df, *(fact(m, f.need("date"), "day", f.number(m), "events", e, fact_class="domain_derived") for m, e in metrics))


@adapter
def robotics_deployments(df):
    """For each record that there is evidence, the quantity if it was disclosed, and a performance figure if there is one."""
    f = Fields(df)
    given = dict(period=f.need("observed_at"), granularity="event_date", entity=f.need("company"), source_url=f("source_url"), dimensions={k: f.need(k) for k in ("status", "deployment_stage", "equipment_type", "factory", "country")})
    quantity, measured = f.number_if_any("quantity"), f.number_if_any("performance_metric.value")
    return facts_of(
        df, fact("deployment_evidence", value=1.0, unit="evidence_events", fact_class="evidence_event", **given),
        fact("disclosed_equipment_quantity", value=quantity, unit=f("quantity_unit"), qualifier=f("quantity_qualifier"), when=quantity.isNotNull(), **given),
        fact(f("performance_metric.name"), value=measured, unit=f("performance_metric.unit"), qualifier=f("performance_metric.qualifier"), when=measured.isNotNull(), **given),
    )


@adapter
def autonomous_logistics_events(df):
    """That an operation happened, with what kind it was."""
    f = Fields(df)
    return facts_of(df, fact("operation_evidence_event", f.need("effective_at"), "event_date", 1.0, "evidence_events", f.need("operator_id"), source_url=f("source_url"), fact_class="evidence_event", dimensions={k: f.need(k) for k in ("event_type", "mode", "operation_status")}))


@adapter
def space_launches_monthly(df):
    f = Fields(df)
    return facts_of(df, fact("completed_launch_count", f.need("month"), "month", f.number("launch_count"), "launches", "Tracked reusable-launch operators", fact_class="domain_derived"))


@adapter
def ark_etf_holdings_latest(df):
    """For each payload the number of its snapshots, and for each fund (a map in `funds`) its rows and the sum of its weights."""
    f = Fields(df)
    period = F.date_format(F.to_date(f.need("as_of"), "MM/dd/yyyy"), "yyyy-MM-dd")
    given = dict(period=period, granularity="as_of_date", fact_class="audit")
    whole = facts_of(df, fact("snapshot_count", value=f.number("snapshot_count"), unit="snapshots", entity="ARK ETF holdings archive", **given))
    funds = df.select("as_of", F.explode("funds").alias("fund", "r"))
    g = Fields(funds)
    own = given | dict(entity=F.col("fund"), source_url=g("r.source_csv_url"))
    return whole.unionByName(facts_of(funds, fact("holding_row_count", value=g.number("r.row_count"), unit="holdings", **own), fact("portfolio_weight_total", value=g.number("r.audit.weight_total"), unit="percent", **own)))


def apply_adapter(name: str, df: DataFrame) -> DataFrame:
    if name not in ADAPTERS:
        raise KeyError(f"no adapter {name}")
    return ADAPTERS[name](df)


def projection(facts: dict[str, DataFrame]) -> DataFrame:
    """All feeds' facts with the feed's name."""
    return reduce(DataFrame.unionByName, (df.withColumn("feed_id", F.lit(n)) for n, df in facts.items()))


def projection_order(df: DataFrame, repo: str = "logical_repo") -> DataFrame:
    """Facts in the order in which projections are written; null counts as ''."""
    return df.orderBy(*(F.coalesce(F.col(c), F.lit("")) for c in (repo, "metric_id", "entity", "period")))


def feed_matrix(sources: DataFrame, feeds: DataFrame) -> DataFrame:
    """Each source with its feed's evidence (feed_id, adapter, row_count), or excluded with its status as the reason."""
    out = sources.join(feeds.select("logical_repo", "feed_id", "adapter", "row_count"), "logical_repo", "left")
    return out.withColumns({"excluded": F.col("feed_id").isNull(), "reason": F.when(F.col("feed_id").isNull(), F.col("status"))})


def catalog_drift(sources: DataFrame, feeds: DataFrame, active=("ready", "accumulating"), prefix: str = "https://raw.githubusercontent.com/") -> DataFrame:
    """(rule, key) where the catalogs of sources and feeds disagree: repeated keys, active sources without just one feed, feeds of inactive sources, other repositories, other hosts."""
    both = sources.groupBy("logical_repo").agg(F.count("*").alias("n"), F.first("status").alias("status"), F.first("current_repo").alias("current_repo"))
    of = feeds.groupBy("logical_repo").agg(F.count("*").alias("feeds"), F.first("repository").alias("repository"), F.first("raw_url").alias("raw_url"))
    j = both.join(of, "logical_repo", "full")
    is_active = F.coalesce(F.col("status").isin(*active), F.lit(False))
    checks = {
        "duplicate_source": F.col("n") > 1, "missing_feed": is_active & F.col("feeds").isNull(), "extra_feed": ~is_active & F.col("feeds").isNotNull(), "several_feeds": F.col("feeds") > 1,
        "repository_drift": F.col("feeds").isNotNull() & (F.col("repository") != F.col("current_repo")), "foreign_url": ~F.col("raw_url").startswith(prefix),
    }
    rows = j.select(F.col("logical_repo").alias("key"), F.explode(F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in checks.items())))).alias("rule"))
    twice = feeds.groupBy("feed_id").count().filter("count > 1").select(F.col("feed_id").alias("key"), F.lit("duplicate_feed").alias("rule"))
    return rows.unionByName(twice).select("rule", "key")
