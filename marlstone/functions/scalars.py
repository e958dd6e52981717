"""Scalar expressions: Column in, Column out, all inside Catalyst but for matched_terms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH_DASH = "－"


def parse_double(c: Column) -> Column:
    """Number, or null for blank, a full-width dash and anything else that isn't one."""
    t = F.trim(c)
    return F.when((t == "") | (t == FULL_WIDTH_DASH), None).otherwise(t.try_cast("double"))


def parse_int_prefix(c: Column) -> Column:
    """The whole number that a text begins with: '12abc' is 12, 'abc' null."""
    return F.nullif(F.regexp_extract(c, r"^\s*([-+]?\d+)", 1), F.lit("")).try_cast("long")


def parse_percent(c: Column) -> Column:
    """'1,234.5%' as 1234.5; null if not a number."""
    return F.trim(F.regexp_replace(c, "[%,]", "")).try_cast("double")


def parse_year(c: Column) -> Column:
    """Year of "'98", '2005', '2005e' or '05'; two digits under 70 are of this century."""
    d = F.regexp_extract(c, r"^\s*'?(\d{4}|\d{2})\s*[A-Za-z]?\s*$", 1)
    n = F.nullif(d, F.lit("")).cast("int")
    return F.when(F.length(d) == 4, n).when(n < 70, n + 2000).otherwise(n + 1900)


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d where d is positive, else null."""
    return F.when(d > 0, n / d)


def try_ratio(n: Column, d: Column) -> Column:
    """n / d, null at d = 0."""
    return n / F.nullif(d, F.lit(0.0))


def security_code(c: Column) -> Column:
    """Five characters that end in 0 lose it; others stay."""
    c = F.upper(F.trim(c))
    return F.when((F.length(c) == 5) & c.endswith("0"), F.left(c, F.lit(4))).otherwise(c)


def valid_security_code(c: Column) -> Column:
    return c.rlike(r"^[0-9][0-9ACDFGHJKLMNPRSTUWXY][0-9][0-9ACDFGHJKLMNPRSTUWXY]$")


def alias_key(c: Column, least: int = 4) -> Column:
    """Lower-cased with white space, signs and underscores of any script removed; null if shorter than `least`."""
    k = F.regexp_replace(F.lower(c), r"(?U)[\s\W_]+", "")
    return F.when(F.length(k) >= least, k)


def has_term(text: Column, term: str) -> Column:
    """Whether a term stands in the text as whole words, without regard to case and kind of white space."""
    flat = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    return F.coalesce(flat.rlike(r"(?U)(?<!\w)\Q" + term.lower() + r"\E(?!\w)"), F.lit(False))


def matched_terms(text: Column, terms: list[str], ascii: bool = False) -> Column:
    """The terms that stand in the text as whole words, sorted and distinct, without regard to case and kind of white space; null has none.

    One automaton of all terms goes over each text once, by Arrow batches, so that the time doesn't grow with the number of terms; terms may
    overlap and lie in each other. The terms, a dictionary that fits a task, go to the executors with the function.

    ascii: only A-Z, a-z, 0-9 and _ are signs of words, as for RE2's \\b, so that any other letter ends one; signs are lower-cased one by one and not casefolded.
    """
    terms = sorted(set(terms))

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        fold = (lambda x: x.replace("\u0130", "i").lower()) if ascii else str.casefold  # of single signs only that one becomes two
        flat = lambda x: " ".join(fold(x).split())
        machine, by_key = ahocorasick.Automaton(), {}
        for t in terms:
            by_key.setdefault(fold(t), []).append(t)
        for key in by_key:
            if key:
                machine.add_word(key, key)
        machine.make_automaton()
        in_word = lambda c: c.isalnum() and (c.isascii() or not ascii) or c == "_"

        def of(x):
            if x is None:
                return []
            x, found = f" {flat(x)} ", set()  # the ends are no word's
            if machine.kind == ahocorasick.AHOCORASICK:
                for last, key in machine.iter(x[1:-1]):
                    if key not in found and not in_word(x[last - len(key) + 1]) and not in_word(x[last + 2]):
                        found.add(key)
            if "" in by_key and any(not in_word(x[i]) and not in_word(x[i + 1]) for i in range(len(x) - 1)):
                found.add("")
            return sorted(t for key in found for t in by_key[key])

        for batch in batches:
            yield batch.map(of)

    return find(text.cast("string"))


def keyword_density(text: Column, words: list[str], digits: int = 2, least: int = 50) -> Column:
    """Occurrences of the words, each counted by itself, for 1000 characters; null for texts of up to `least`."""
    n = reduce(lambda a, b: a + b, (F.regexp_count(text, F.lit(r"\Q" + w + r"\E")) for w in words))
    return F.when(F.length(text) > least, F.round(n / F.length(text) * 1000, digits))


def snippet(c: Column, most: int = 300) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def month_key(c: Column) -> Column:
    """YYYY-MM of an ISO date or timestamp text; null if it isn't one."""
    return F.when(c.rlike(r"^\d{4}-(0[1-9]|1[0-2])-\d{2}"), F.left(c, F.lit(7)))


def column_name(s: str) -> str:
    """A header as a column name: lower-cased, with runs of other signs than a-z and 0-9 as one underscore."""
    import re

    return re.sub("[^a-z0-9]+", "_", s.lower()).strip("_")


def us_date(c: Column) -> Column:
    return F.try_to_date(c, "MM/dd/yyyy")


def utc(c: Column) -> Column:
    """Timestamp of an ISO text with a zone; null without one."""
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))


def string_list(c: Column) -> Column:
    """A JSON list of strings that came as text."""
    return F.from_json(c, "array<string>")


def same_sizes(*arrays: Column) -> Column:
    return reduce(lambda a, b: a & b, (F.size(x) == F.size(arrays[0]) for x in arrays[1:]), F.lit(True))


def zip_structs(**arrays: Column) -> Column:
    return F.arrays_zip(*(a.alias(n) for n, a in arrays.items()))


def sha(*parts: Column, sep: str = "|", length: int = 64) -> Column:
    """The first digits of the SHA-256 of the parts, joined."""
    return F.left(F.sha2(F.concat_ws(sep, *parts), 256), F.lit(length))


def snapshot_id(dataset: Column, reuse_key: Column, observed_at: Column, digest: Column) -> Column:
    return sha(dataset, reuse_key, observed_at, digest, length=20)


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def byte_size(c: Column, largest: str = "GB") -> Column:
    """'1.5 KB' and the like, without separators of thousands ('1000.0 KB'); sizes beyond the largest unit, KB, MB or GB, are told in it."""
    units = ["KB", "MB", "GB"][: ["KB", "MB", "GB"].index(largest) + 1]
    told = lambda i: F.concat(F.call_function("format_number", c / 1024.0 ** (i + 1), F.lit("0.0")), F.lit(f" {units[i]}"))
    out = told(len(units) - 1)
    for i in reversed(range(len(units) - 1)):
        out = F.when(c < 1024 ** (i + 2), told(i)).otherwise(out)
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).otherwise(out)


def url_host(url: Column, fallback: Column | None = None) -> Column:
    host = F.try_parse_url(url, F.lit("HOST"))
    return host if fallback is None else F.coalesce(F.nullif(fallback, F.lit("")), host)


def safe_path(c: Column) -> Column:
    """A relative path without parent steps."""
    return ~(c.startswith("/") | c.rlike(r"(^|/)\.\.(/|$)") | c.contains("\\")) & (c != "")


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c.cast("string") != "", c) for c in cs))


def intraday_return(opened: Column, closed: Column) -> Column:
    return try_ratio(closed - opened, opened)


def money(initial: float, total_return: Column) -> tuple[Column, Column]:
    """Final value and gain of a sum that earned the return."""
    return F.lit(initial) * (1 + total_return), F.lit(initial) * total_return


def squash(c: Column, long_above: float = 0.33, short_below: float = -0.33, gain: float = 5.0) -> Column:
    """Struct (score in -1..1, action, confidence) of a raw signal: tanh of gain times it; a score at a threshold is neutral."""
    s = F.tanh(c * gain)
    return F.struct(s.alias("score"), F.when(s > long_above, "long").when(s < short_below, "short").otherwise("neutral").alias("action"), F.abs(s).alias("confidence"))


def regime_direction(pc1: Column, direction: Column, extreme: float = 2.0) -> Column:
    """The direction, reversed in an extreme regime."""
    return F.when(F.abs(pc1) > extreme, -direction).otherwise(direction)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def json_key_exists(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).isNotNull()


def arxiv_id(c: Column) -> Column:
    """The identifier of an abstract's or PDF's url or of a bare id, without its version; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?:^|/)(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$", 1), F.lit(""))


def arxiv_version(c: Column) -> Column:
    """The number behind 'v' of a versioned identifier; null if it has none."""
    return F.nullif(F.regexp_extract(c, r"\d{4}\.\d{4,5}v(\d+)", 1), F.lit("")).cast("int")


def url_suffix(c: Column, ending: str) -> Column:
    """The first url in a text that ends so."""
    return F.nullif(F.regexp_extract(c, r"(https?://\S+" + ending.replace(".", "[.]") + ")", 1), F.lit(""))
