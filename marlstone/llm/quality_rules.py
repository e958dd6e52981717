"""Quality rules whose cutoffs are chosen under a bound on false rejection, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Words of a window that may repeat, and the base rules' limits: least words, and percent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: A stratum's share of good documents that all rules together may reject, and the probability that any stratum's share is larger.
RISK, FAILURE = 0.05, 0.05


@dataclass(frozen=True)
class Rule:
    """Rejects a text if 100 * part > cutoff * whole (or <, if above is false); cutoffs go from the most lenient to the strictest."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[int, ...]
    above: bool = True


#: The grids are fixed before any label is seen; that is what the bound's correctness rests on.
RULES = (
    Rule("symbols", "n_symbols", "n_words", (200, 150, 100, 75, 50, 30, 20, 10)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (90, 80, 70, 60, 50, 40, 30)),
    Rule("repeats", "n_repeat_words", "n_words", (19, 18, 17, 16, 15)),
    Rule("long_words", "word_chars", "n_words", (1500, 1200, 1000, 900, 800)),
    Rule("short_words", "word_chars", "n_words", (150, 200, 250, 300), False),
)


def let(value: Column, f) -> Column:
    """f(value), where value is computed once for each row, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """How many words stand in windows of n words that occur twice or more in the array; windows are told apart by 64-bit hashes.

    Windows are sorted only in texts that have a repeated one.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(starts, F.struct(F.lit(-n).cast("long").alias("last"), F.lit(0).cast("long").alias("sum")), lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.least(F.lit(n), x - s["last"])).alias("sum")), lambda s: s["sum"])

    def repeated(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(x["g"] == F.get(ordered, i - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(ordered, i + 1)["g"], F.lit(False))
        return covered(F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"])))

    def among(grams: Column) -> Column:
        pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), repeated))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) > n, let(windows(h), among)).otherwise(F.lit(0).cast("long")))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed of every row's whole text; a null text has no words.

    keep: further columns that stay. Nothing shuffles; memory is a small multiple of the longest text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = docs.select(
        F.col(id_col).alias("id"),
        *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("x"),
        F.when(F.rlike(text, F.lit(f"[{SYMBOLS}]")), F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
    )
    failed = (F.col("w.n_words") < LEAST_WORDS) | (100 * F.col("w.n_repeat_words") > MOST_REPEATED * F.col("w.n_words"))
    return counted.select(F.col("id").alias(id_col), *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "w.n_words", "w.word_chars", "n_symbols", "x.n_lines", "x.n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"))


def first_step(rule: Rule) -> Column:
    """The first of the rule's cutoffs, counted from 1, that rejects a row; one more than there are if none does."""
    part, whole = 100 * F.col(rule.part), F.col(rule.whole)
    out = F.lit(len(rule.cutoffs) + 1)
    for i, c in reversed(list(enumerate(rule.cutoffs, 1))):
        out = F.when(part > c * whole if rule.above else part < c * whole, F.lit(i)).otherwise(out)
    return F.when(whole > 0, out).otherwise(F.lit(len(rule.cutoffs) + 1))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X(n, p) by its exact terms, each from the logarithm of the one before; 1 for k > n p, where no bound below a half can hold."""
    odds = math.log(p / (1 - p))
    first = F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        log = s["log"] + F.ln((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    more = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(more, first, step, lambda s: s["sum"]))


def cutoffs(labelled: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES, risk: float = RISK, failure: float = FAILURE) -> DataFrame:
    """(stratum, steps): for each rule the number of its cutoffs that hold; the last of them is the one to use, 0 is none.

    labelled: measured rows with the stratum and a boolean column `good`. Of a stratum's good rows that the base rules pass, n, a cutoff
    rejects k. It holds if P(X <= k) <= failure / (strata * rules) for X of n trials with probability risk / rules: the exact
    binomial test of "this cutoff's false rejection is larger". A rule's cutoffs are tested from the most lenient on until one
    fails, which needs no correction; over strata and rules the correction is Bonferroni's. So with probability 1 - failure
    no stratum loses more than `risk` of such rows to all rules together. With too few labels nothing holds, and nothing is rejected.
    One aggregate over the rows, combined in the map tasks: strata x rules x cutoffs counts.
    """
    steps = labelled.filter(F.col("good") & ~F.col("base_failed")).select(F.col(stratum).alias("stratum"), *(first_step(r).alias(f"s{i}") for i, r in enumerate(rules)))
    counts = steps.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col(f"s{i}") <= s).alias(f"k{i}_{s}") for i, r in enumerate(rules) for s in range(1, len(r.cutoffs) + 1)))
    counts = base.stash(counts)
    tests = counts.count() * len(rules)
    ok = lambda i, s: binomial_tail(F.col(f"k{i}_{s}"), F.col("n"), risk / len(rules)) <= failure / max(1, tests)

    def holding(i: int, rule: Rule) -> Column:
        out = F.lit(len(rule.cutoffs))
        for s in reversed(range(1, len(rule.cutoffs) + 1)):
            out = F.when(ok(i, s), out).otherwise(F.lit(s - 1))
        return out

    return base.stash(counts.select("stratum", F.array(*(holding(i, r) for i, r in enumerate(rules))).alias("steps")))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang", label_col: str = "quality", rules: tuple[Rule, ...] = RULES, risk: float = RISK, failure: float = FAILURE) -> DataFrame:
    """One row per row of docs: id, the measures, base_failed, kept, and rejected_by, the names of the rules that reject it, comma-joined.

    labels: (id_col, label_col); 1 is a good document. An id with several labels is good if one of them is 1; labels that are null or of
    unknown ids say nothing. stratum: a column of docs (null is a stratum of its own), or None for one stratum. A base_failed row
    is not kept, whatever the rules say. Texts are read once: measures are written, and both the holdout's counts and the verdicts read these.
    Only ids of labels shuffle, or none if the labels fit in a broadcast. Empty tables give empty results or, without labels, no rejections.
    Columns of docs other than these three aren't read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(stratum) if stratum else F.lit("")).alias("stratum"))
    rows = base.stash(measures(docs, "id", "text", ("stratum",)))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null")
    known = base.stash(known.groupBy("id").agg((F.max("label") == 1).alias("good")))
    chosen = cutoffs(rows.join(base.bounded(known, 64), "id"), "stratum", rules, risk, failure)
    side = base.bounded(chosen.select(F.col("stratum").alias("of"), "steps"), 256)
    names = F.array(*(F.when(first_step(r) <= F.get("steps", F.lit(i)), F.lit(r.name)) for i, r in enumerate(rules)))
    out = rows.join(side, F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("names", F.array_compact(names))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(F.size("names"), F.lit(0)) <= 0)).alias("kept"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("rejected_by"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows of ids that judge() drops; all columns stay. Rows that share an id share the worst verdict; null ids stay."""
    (gone,) = base.fresh(docs, "gone")
    out = base.stash(judge(docs, labels, id_col, **options).filter("not kept").select(F.col(id_col).alias(gone)).distinct())
    return docs.join(base.bounded(out, 64), F.col(id_col) == F.col(gone), "left_anti")


def _twin() -> str:
    """SQL of op11_quality_rules from the same rules and bounds."""
    sql = lambda r, c: f"{r.whole} > 0 and 100 * {r.part} {'>' if r.above else '<'} {c} * {r.whole}"
    tests, alpha = [], RISK / len(RULES)
    for i, r in enumerate(RULES):
        tests += [f"select lang, {i} r, {s} s, count(*) n, count(*) filter ({sql(r, c)}) k from good group by lang" for s, c in enumerate(r.cutoffs, 1)]
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r}))"
    rejects = []
    for i, r in enumerate(RULES):
        whens = " ".join(f"when h{i} >= {s} and ({sql(r, c)}) then '{r.name}'" for s, c in enumerate(r.cutoffs, 1))
        rejects.append(f"case {whens} end")
    held = ", ".join(f"max(held) filter (r = {i}) h{i}" for i in range(len(RULES)))
    return f"""
    with t as (select doc_id, lang, coalesce(text, '') t from documents),
    w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from t),
    p as (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i from w where len(ws) >= {WINDOW}),
    g as (select doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') g from p),
    d as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) n from g) where n > 1),
    c as (select doc_id, sum(least({WINDOW}, coalesce(i - b, {WINDOW}))) n from (select *, lag(i) over (partition by doc_id order by i) b from d) group by 1),
    m as (select w.doc_id, lang, len(ws) n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) n_symbols, len(ls) n_lines,
        len(ls) - len(list_distinct(ls)) n_dup_lines, cast(coalesce(c.n, 0) as bigint) n_repeat_words from w left join c on c.doc_id = w.doc_id),
    f as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words base_failed from m),
    good as (select f.* from f join (select doc_id, max(quality) q from labels where quality is not null group by 1) l on f.doc_id = l.doc_id where q = 1 and not base_failed),
    tests as ({" union all ".join(tests)}),
    ok as (select lang, r, s, k <= n * {alpha!r} and list_sum(list_transform(range(0, k + 1), lambda i: {term})) <= {FAILURE!r} / ({len(RULES)} * (select count(*) from (select distinct lang from good))) ok from tests),
    held as (select lang, r, coalesce(min(s) filter (not ok) - 1, max(s)) held from ok group by 1, 2),
    wide as (select lang, {held} from held group by 1),
    v as (select f.*, concat_ws(',', {", ".join(rejects)}) rejected_by from f left join wide on f.lang is not distinct from wide.lang)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rejected_by = '' kept, rejected_by from v
    """


@base.query("op11_quality_rules", _twin())
def op11_quality_rules(spark, sf_dir):
    return judge(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))
