"""Fail-closed data quality: rules give violations, and a pipeline that finds any stops."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import relational as R


class QualityError(ValueError):
    """A rule found violations."""


def violations(spark: SparkSession, *found: DataFrame) -> DataFrame:
    """One frame (rule, key, detail) of those of several rules."""
    empty = spark.createDataFrame([], "rule string, key string, detail string")
    return reduce(DataFrame.unionByName, found, empty)


def assert_empty(found: DataFrame, show: int = 5) -> None:
    """Raise QualityError with the first violations, if there are any."""
    rows = found.limit(show).collect()
    if rows:
        raise QualityError("; ".join(f"{r.rule}: {r.key} {r.detail}" for r in rows))


def _rule(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return sorted(set(columns) - set(df.columns))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One violation for each column that is absent, has nulls, or of an empty frame; one pass."""
    spark, absent = df.sparkSession, missing_columns(df, columns)
    found = [spark.createDataFrame([("required_column", c, "absent") for c in absent], "rule string, key string, detail string")]
    here = [c for c in columns if c not in absent]
    counts = df.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in here))
    if here:
        long = counts.unpivot(["__n"], here, "key", "nulls")
        found.append(_rule(long.filter("nulls > 0"), "required_not_null", F.col("key"), F.col("nulls")))
    found.append(_rule(counts.filter("__n = 0"), "non_empty", F.lit("*"), F.lit("no rows")))
    return violations(spark, *found)


def unique_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    n = df.groupBy(*key).agg(F.count("*").alias("__n")).filter("__n > 1")
    return _rule(n, "unique_key", F.concat_ws("|", *key), F.col("__n"))


def in_domain(df: DataFrame, key: str, column: str, values: Sequence | None = None, pattern: str | None = None) -> DataFrame:
    c = F.col(column)
    ok = c.isin(list(values)) if values is not None else c.rlike(pattern)
    return _rule(df.filter(~F.coalesce(ok, F.lit(False))), "domain", F.col(key), F.concat(F.lit(f"{column}="), F.coalesce(c.cast("string"), F.lit("null"))))


def in_range(df: DataFrame, key: str, column: str, low, high) -> DataFrame:
    c = F.col(column)
    return _rule(df.filter(~F.coalesce(c.between(low, high), F.lit(False))), "range", F.col(key), F.concat(F.lit(f"{column}="), F.coalesce(c.cast("string"), F.lit("null"))))


def chronological(df: DataFrame, key: Sequence[str], ordinal: str, time: str) -> DataFrame:
    """Rows whose time is not after that of the row before."""
    before = F.lag(time).over(Window.partitionBy(*key).orderBy(ordinal))
    bad = df.withColumn("__b", before).filter(F.col("__b").isNotNull() & ~(F.col(time) > F.col("__b")))
    return _rule(bad, "chronological", F.concat_ws("|", *key, F.col(ordinal).cast("string")), F.col(time))


def row_count(df: DataFrame, wanted: int) -> DataFrame:
    n = df.agg(F.count("*").alias("n")).filter(F.col("n") != wanted)
    return _rule(n, "row_count", F.lit("*"), F.concat(F.col("n").cast("string"), F.lit(f" for {wanted}")))


def same_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are on one side only, by one full outer join."""
    both = a.select(*key).distinct().withColumn("__a", F.lit(1)).join(b.select(*key).distinct().withColumn("__b", F.lit(1)), list(key), "full")
    bad = both.filter("__a IS NULL OR __b IS NULL")
    return _rule(bad, "same_keys", F.concat_ws("|", *key), F.when(F.col("__a").isNull(), "missing left").otherwise("missing right"))


def hash_equal(files: DataFrame, wanted: str = "sha256") -> DataFrame:
    """Files (path, content, and the wanted digest) whose content has another digest."""
    return _rule(files.filter(F.sha2("content", 256) != F.col(wanted)), "content_hash", F.col("path"), F.sha2("content", 256))


def recomputed(df: DataFrame, key: str, stored: str, again: Column, rel: float = 1e-9) -> DataFrame:
    ok = F.coalesce(S.is_close(F.col(stored), again, rel), F.col(stored).isNull() & again.isNull())
    return _rule(df.filter(~ok), "recomputed", F.col(key), F.concat_ws(" for ", F.col(stored).cast("string"), again.cast("string")))


def _listed(df: DataFrame, key: Column, checks: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """A violation for each check that holds; one pass."""
    each = F.explode(F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in checks.items()))))
    return df.select(each.alias("rule"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


#: Columns that a daily bar must have.
BAR_COLUMNS = ("Code", "Date", "AdjustmentClose", "AdjustmentVolume")


def bar_rules(df: DataFrame, symbols: DataFrame | None = None, code: str = "Code", date: str = "Date") -> DataFrame:
    """Errors and warnings of daily bars: (rule, key, detail), rules of warnings beginning with 'warn_'.

    A null in one of BAR_COLUMNS is missing_<column>; a close that isn't a number is an error, a volume that isn't one a warning; of symbols (their column `code`) that have no bar, no_records.
    """
    checks = {f"missing_{c}": F.col(c).isNull() for c in BAR_COLUMNS} | {"nan_AdjustmentClose": F.isnan("AdjustmentClose"), "warn_nan_AdjustmentVolume": F.isnan("AdjustmentVolume")}
    out = _listed(df, F.col(code), checks, F.col(date))
    if symbols is not None:
        out = out.unionByName(_rule(symbols.join(df.select(code), code, "left_anti"), "no_records", F.col(code), F.lit("")))
    return out


def bar_validity(df: DataFrame, symbols: DataFrame, code: str = "Code") -> DataFrame:
    """(code, records, errors, warnings, valid) for each symbol: valid if it has bars and none of them an error."""
    n = df.groupBy(F.col(code).alias("key")).agg(F.count("*").alias("records"))
    warns = F.col("rule").startswith("warn_")
    found = bar_rules(df, symbols, code).groupBy("key").agg(F.count_if(~warns).alias("errors"), F.count_if(warns).alias("warnings"))
    out = symbols.select(F.col(code).cast("string").alias("key")).distinct().join(n, "key", "left").join(found, "key", "left").na.fill(0)
    return out.withColumn("valid", F.col("errors") == 0).withColumnRenamed("key", code)


def partition_of(whole: DataFrame, *parts: DataFrame) -> DataFrame:
    """Violations of parts being disjoint and covering the whole."""
    union = reduce(DataFrame.unionByName, parts)
    lost, extra = whole.exceptAll(union), union.exceptAll(whole)
    return violations(whole.sparkSession, _rule(lost, "covers", F.to_json(F.struct("*")), F.lit("lost")), _rule(extra, "disjoint", F.to_json(F.struct("*")), F.lit("extra")))


def frozen_split(df: DataFrame, id_col: str, group: str, fraction: float = 0.2, seed: int = 20260803, expected: int | None = None) -> DataFrame:
    """df with `evaluation`: of each group of n rows the first clamp(int(n * fraction + .5), 1, n - 1) by SHA-256 of seed, group and id; groups of one have none.

    It depends on nothing but these values. Null or repeated ids, null groups and another number of rows than expected fail.
    """
    bad = violations(df.sparkSession, unique_key(df, [id_col]), *(_rule(df.filter(F.col(c).isNull()), "not_null", F.lit(c), F.lit("")) for c in (id_col, group)))
    assert_empty(bad if expected is None else bad.unionByName(row_count(df, expected)))
    rank = F.sha2(F.concat_ws("\0", F.lit(str(seed)), F.col(group).cast("string"), F.col(id_col).cast("string")), 256)
    n = F.count("*").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(rank, F.col(id_col)))
    take = F.when(n > 1, F.greatest(F.lit(1), F.least(n - 1, F.floor(n * fraction + 0.5)))).otherwise(0)
    return df.withColumn("evaluation", place <= take)


REQUIRED_SNAPSHOT = ("snapshot_id", "dataset_id", "reuse_key", "artifact_path", "artifact_sha256", "observed_at", "status")


def audit_snapshots(df: DataFrame, provenance: Sequence[str] = ()) -> DataFrame:
    """Violations of a snapshot catalog: required fields, paths, ids that don't follow from their parts, repeated coordinates, missing provenance keys."""
    key = F.col("snapshot_id")
    again = S.snapshot_id(F.col("dataset_id"), F.col("reuse_key"), F.col("observed_at"), F.col("artifact_sha256"))
    lack = F.array_except(F.array(*map(F.lit, provenance)).cast("array<string>"), F.map_keys("provenance")) if provenance else F.array().cast("array<string>")
    return violations(
        df.sparkSession, require_columns(df, REQUIRED_SNAPSHOT), _rule(df.filter(~S.safe_path(F.col("artifact_path"))), "safe_path", key, F.col("artifact_path")), _rule(df.filter(key != again), "snapshot_id", key, again),
        unique_key(df, ["reuse_key", "observed_at"]), unique_key(df, ["snapshot_id"]), _rule(df.filter(F.size(lack) > 0), "provenance", key, F.array_join(lack, ",")),
    )


def audit_ledger(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Violations of ledger entries against their registered sources: unknown, disabled, not fail-closed, another adapter, unsafe or repeated path."""
    r = registry.select("source_id", F.col("enabled").alias("__e"), F.col("fail_closed").alias("__f"), F.col("adapter").alias("__a"))
    j = entries.join(r, "source_id", "left")
    checks = {"registered": F.col("__e").isNull(), "enabled": ~F.col("__e"), "fail_closed": ~F.col("__f"), "adapter": F.col("__a") != F.col("adapter"), "safe_path": ~S.safe_path(F.col("path"))}
    found = j.select("source_id", "path", F.explode(F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in checks.items())))).alias("__r"))
    return violations(entries.sparkSession, found.select(F.col("__r").alias("rule"), F.col("source_id").alias("key"), F.col("path").alias("detail")), unique_key(entries, ["path"]))


def latest_snapshot(df: DataFrame) -> DataFrame:
    """The snapshot of the latest UTC time for each reuse key; of equal times the first by id."""
    t = S.utc(F.col("observed_at"))
    w = Window.partitionBy("reuse_key").orderBy(t.desc(), F.col("snapshot_id"))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def state_rules(df: DataFrame, key: str = "id") -> DataFrame:
    """Violations of run states: NOT_RUN has no verdict, BLOCKED no metrics, COMPLETE both."""
    checks = {"not_run_verdict": (F.col("state") == "NOT_RUN") & F.col("verdict").isNotNull(), "blocked_metrics": (F.col("state") == "BLOCKED") & F.col("metrics").isNotNull(), "complete": (F.col("state") == "COMPLETE") & (F.col("verdict").isNull() | F.col("metrics").isNull())}
    found = df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in checks.items())))).alias("rule"))
    return found.select("rule", "key", F.lit("").alias("detail"))


#: Fixed values of the paper's protocol: groups of features, and indices whose members must be known by date.
FEATURE_GROUPS = (
    "price_based", "volume_liquidity", "technical_indicators", "corporate_actions", "fundamentals", "earnings_surprises", "insider_trading", "sentiment",
    "governance", "macroeconomic", "rates_curves", "volatility_options", "cross_asset_indices", "sector_indices", "metadata",
)
TIME_VARYING_INDICES = ("GSPC", "NDX", "FTSE", "GDAXI", "HSI", "DJI")


def missing_features(df: DataFrame, features: str, wanted: Sequence[str] = FEATURE_GROUPS) -> DataFrame:
    return df.withColumn("blockers", F.array_except(F.array(*map(F.lit, wanted)), F.col(features)))


def readiness(df: DataFrame, start: str = "2004-01-01", end: str = "2024-12-31", provider: str = "bloomberg") -> DataFrame:
    """df with blockers, in order, and ready (whether there are none).

    df: manifests (source_start, source_end, feature_groups array, index_membership map, providers array; a null is empty). The history must begin by `start` and hold `end`, all of
    FEATURE_GROUPS must be there, all of TIME_VARYING_INDICES be time-varying, and the licensed provider be among those named, without regard to case.
    """
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    groups = F.array_sort(F.array_except(F.array(*map(F.lit, FEATURE_GROUPS)), strings(F.col("feature_groups"))))
    fixed = F.filter(F.array(*map(F.lit, TIME_VARYING_INDICES)), lambda i: ~F.coalesce(F.try_element_at("index_membership", i) == "time-varying", F.lit(False)))
    late = F.coalesce(F.try_to_date(F.col("source_start").cast("string")) > F.lit(start).cast("date"), F.lit(True))
    early = F.coalesce(F.try_to_date(F.col("source_end").cast("string")) < F.lit(end).cast("date"), F.lit(True))
    known = F.array_contains(F.transform(strings(F.col("providers")), F.lower), provider)
    checks = (
        (F.lit(f"source history must start no later than {start}"), late), (F.lit(f"source history must include {end}"), early), (F.concat(F.lit("missing feature groups: "), F.array_join(groups, ", ")), F.size(groups) > 0),
        (F.concat(F.lit("missing time-varying constituent history: "), F.array_join(fixed, ", ")), F.size(fixed) > 0), (F.lit("licensed vendor data are required"), ~known),
    )
    return df.withColumn("blockers", F.array_compact(F.array(*(F.when(w, says) for says, w in checks)))).withColumn("ready", F.size("blockers") == 0)


def stale(df: DataFrame, key: str, year: str, most: int = 1, now: Column | None = None) -> DataFrame:
    """Keys whose latest year is more than `most` years back."""
    last = df.groupBy(key).agg(F.max(year).alias("__y"))
    return _rule(last.filter(F.col("__y") < F.year(now if now is not None else F.current_date()) - most), "stale", F.col(key), F.col("__y"))


def annual_history(df: DataFrame, key: str, year: str, first_year: int, now: Column, grace: int = 2, floor: int | None = None) -> DataFrame:
    """Violations of annual series by key: another first year, a latest year before the required one (the year of `now` less grace, at least floor), years missing in between."""
    a = df.groupBy(key).agg(F.min(year).alias("a"), F.max(year).alias("z"), F.count("*").alias("n"))
    required = F.year(now) - grace if floor is None else F.greatest(F.lit(floor), F.year(now) - grace)
    return _listed(a, F.col(key), {"first_year": F.col("a") != first_year, "stale": F.col("z") < required, "not_contiguous": F.col("n") != F.col("z") - F.col("a") + 1}, F.col("z"))


def retained(df: DataFrame, key: str, year: str, now: Column) -> DataFrame:
    """Violations of baselines that are kept while a source is away: the latest year must be last year's from April on, else that before."""
    required = F.year(now) - F.when(F.month(now) >= 4, 1).otherwise(2)
    last = df.groupBy(key).agg(F.max(year).alias("z"))
    return _listed(last, F.col(key), {"stale": F.col("z") < required}, F.col("z"))


def counts_by_year(df: DataFrame, year: str, wanted: DataFrame) -> DataFrame:
    """Years whose number of rows is not the wanted one (year, n)."""
    got = df.groupBy(F.col(year).alias("year")).agg(F.count("*").alias("got"))
    both = got.join(wanted, "year", "full").filter(~F.col("got").eqNullSafe(F.col("n")))
    return _rule(both, "year_count", F.col("year"), F.concat_ws(" for ", "got", "n"))


def json_nodes(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """(__key, name, node): every value below a JSON document, however deep, with the name that it stands under (null in arrays), as a variant. What isn't JSON has none.

    A recursive query whose every step opens the values of the step before, until none is left. Deeper than relational.MOST_LEVELS is an error.
    """
    rows = df.select(F.col(key).alias("__key"), F.try_parse_json(json_col).alias("node"))
    return R.recursive(
        rows,
        """WITH RECURSIVE nodes(__key, depth, name, node) MAX RECURSION LEVEL {levels} AS (
            SELECT __key, 0, CAST(NULL AS STRING), node FROM {rows}
            UNION ALL
            SELECT n.__key, n.depth + 1, x.key, x.value FROM nodes n, LATERAL variant_explode(n.node) x
        ) SELECT __key, name, node FROM nodes WHERE depth > 0""",
    )


def forbidden_keys(df: DataFrame, key: str, json_col: str, names: Sequence[str]) -> DataFrame:
    """Rows whose JSON has one of the names as a key of an object, at any depth; the same text within a value is none."""
    nodes = json_nodes(df, key, json_col).filter(F.col("name").isin(list(names)))
    found = nodes.groupBy("__key").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("n"))
    return _rule(found, "forbidden_key", F.col("__key"), F.col("n"))


def json_urls(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """(key, url): the distinct urls among the text values of JSON documents, at any depth."""
    nodes = json_nodes(df, key, json_col)
    text = F.try_variant_get("node", "$", "string")
    return nodes.select(F.col("__key").alias(key), text.alias("url")).filter(F.col("url").rlike("^https?://")).distinct()


def capture_rules(df: DataFrame, key: str = "id") -> DataFrame:
    checks = {"captured_before_cutoff": F.col("captured_at") < F.col("cutoff"), "more_rows_than_matches": F.size("rows") > F.col("result_count")}
    found = df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in checks.items())))).alias("rule"))
    return found.select("rule", "key", F.lit("").alias("detail"))


def provider_state(json_col: Column) -> Column:
    """Which state a provider's JSON answer shows."""
    has = lambda k: S.json_key_exists(json_col, f"$['{k}']")
    return F.when(has("Time Series (Daily)"), "supported").when(has("Note"), "rate_limited").when(has("Information"), "provider_information").when(has("Error Message"), "unsupported").otherwise("invalid")


def evidence_in_time(df: DataFrame) -> DataFrame:
    """Violations of snapshots whose evidence became available after the cutoff, or that were recorded before it."""
    late = F.exists("evidence", lambda e: e["available_at"] > F.col("information_cutoff"))
    checks = {"late_evidence": late, "early_record": F.col("recorded_at") < F.col("information_cutoff")}
    found = df.select(F.col("id").cast("string").alias("key"), F.explode(F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in checks.items())))).alias("rule"))
    return found.select("rule", "key", F.lit("").alias("detail"))


def same_summary(rows: DataFrame, summary: DataFrame, key: Sequence[str], n: str = "n") -> DataFrame:
    """Violations of a stored summary of counts by key against a recount."""
    again = rows.groupBy(*key).agg(F.count("*").alias("__a"))
    both = again.join(summary.select(*key, F.col(n).alias("__b")), list(key), "full").filter(~F.col("__a").eqNullSafe(F.col("__b")))
    return _rule(both, "summary", F.concat_ws("|", *key), F.concat_ws(" for ", "__a", "__b"))


@dataclass(frozen=True)
class Registry:
    """Validators by name; an unknown name fails."""

    known: dict

    def check(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.known:
            raise QualityError(f"no validator {name}")
        return self.known[name](df)


#: What a manifest of empirical evidence must say.
EVIDENCE_SCHEMA, EVIDENCE_STATE = "paper-evidence-manifest.v1", "EMPIRICALLY_RUN"


def audit_evidence(manifests: DataFrame, reports: DataFrame, artifacts: DataFrame, files: DataFrame, verdicts: Sequence[str]) -> DataFrame:
    """Violations along the chain from runs to what is registered of them: (rule, key, detail) by run_id.

    manifests: run_id, schema_version, state, verdict, mutable_path_is_evidence. reports: run_id, state, verdict. artifacts: run_id, kind, sha256 as registered. files: run_id, kind, content.
    A run needs one manifest and one report of the same, allowed verdict and an empirical state; a mutable path must be named as no evidence; every file's digest must be the registered one and every registered artifact have a file.
    """
    r = reports.select("run_id", F.col("state").alias("__s"), F.col("verdict").alias("__v"))
    j = manifests.join(r, "run_id", "left")
    checks = {
        "schema": ~F.coalesce(F.col("schema_version").endswith(EVIDENCE_SCHEMA), F.lit(False)), "not_empirical": ~F.coalesce((F.col("state") == EVIDENCE_STATE) & (F.col("__s") == EVIDENCE_STATE), F.lit(False)), "no_report": F.col("__v").isNull(),
        "verdict_mismatch": F.col("verdict") != F.col("__v"), "verdict_unknown": ~F.coalesce(F.col("__v").isin(list(verdicts)), F.lit(False)), "mutable_path": ~F.coalesce(~F.col("mutable_path_is_evidence"), F.lit(False)),
    }
    both = artifacts.join(files.select("run_id", "kind", F.sha2("content", 256).alias("__h")), ["run_id", "kind"], "full")
    kinds = _listed(both, F.col("run_id"), {"unregistered_file": F.col("sha256").isNull(), "missing_file": F.col("__h").isNull(), "hash_mismatch": F.col("sha256") != F.col("__h")}, F.col("kind"))
    return violations(manifests.sparkSession, unique_key(manifests, ["run_id"]), _listed(j, F.col("run_id"), checks), kinds)


def pinned_inputs(selected: DataFrame, pins: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, blocked): selected papers with their verified version pins, and those whose pin is missing, not VERIFIED, or lacks a required field. Repeated pins stop the run."""
    assert_empty(unique_key(pins, ["arxiv_id"]))
    j = selected.join(pins, "arxiv_id", "left")
    whole = reduce(lambda a, b: a & b, (F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in required))
    ok = F.coalesce(F.col("availability_status") == "VERIFIED", F.lit(False)) & whole
    return j.filter(ok), j.filter(~ok).select("arxiv_id").distinct()
