"""Secret scan: Boolean trigram queries derived from each rule's regex, answered by an inverted index; DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

_sre = re._parser


@dataclass(frozen=True)
class Rule:
    """regex: in the common subset of Java's and Python's syntax. A match counts if its group is at least `least` long."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The contract's kinds, in the order listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Further kinds of public token formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)

_MOST = 64  # strings that are kept apart while a regex is read


def trigram_query(regex: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-cased trigrams that every match must contain; [frozenset()] if any text may match."""
    return _query(list(_sre.parse(regex)))


def _and(a, b):
    out = {x | y for x, y in product(a, b)}
    return [x for x in out if not any(y < x for y in out)] if len(out) <= _MOST else list(a)


def _of(strings) -> list[frozenset[str]]:
    out = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return [frozenset()] if frozenset() in out else list(out)


def _strings(item) -> set[str] | None:
    """All strings that a node may match, if few."""
    op, arg = str(item[0]), item[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
        return {chr(c).lower() for _, c in arg}
    if op == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
        chars = {chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1) if a[1] - a[0] < 8 else [])}
        return {c.lower() for c in chars} if chars and all(str(o) == "LITERAL" or a[1] - a[0] < 8 for o, a in arg) and len(chars) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence(arg[3])
    if op == "BRANCH":
        each = [_sequence(x) for x in arg[1]]
        return set().union(*each) if all(x is not None for x in each) and sum(map(len, each)) <= _MOST else None
    if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1 and arg[0] == 0:
        inner = _sequence(arg[2])
        return None if inner is None else inner | {""}
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for x in items:
        if (s := _strings(x)) is None or len(out) * len(s) > _MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def _query(items) -> list[frozenset[str]]:
    found, run = [frozenset()], {""}
    for item in [*items, None]:
        s = _strings(item) if item else None
        if s is not None and len(run) * len(s) <= _MOST:
            run = {a + b for a in run for b in s}
            continue
        found, run = _and(found, _of(run)), s or {""}
        op, arg = (str(item[0]), item[1]) if item else ("", None)
        if s is None and op == "SUBPATTERN":
            found = _and(found, _query(list(arg[3])))
        elif s is None and op == "BRANCH":
            found = _and(found, list({y for x in arg[1] for y in _query(list(x))}))
        elif s is None and op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            found = _and(found, _query(list(arg[2])))
        elif s is not None and item is items[-1]:
            found, run = _and(found, _of(run)), {""}
    return [frozenset()] if frozenset() in found else sorted(found, key=sorted)


#: Places of the postings for each row: a row whose place a candidate shares is verified for nothing.
PLACES_A_ROW = 4


def _place(id_col: str, text_col: str, places: int) -> Column:
    return F.pmod(base.row_key(F.col(id_col), F.col(text_col)), F.lit(places)) + 1


def postings(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str, places: int) -> DataFrame:
    """The inverted index: (trigram number, bucket, bitmap of the places of the rows that contain it, without regard to A-Z case).

    A row's place is a hash of its id and text, so that ids may be of any type, far apart or repeated. A posting list is cut into
    bitmaps of 32,768 places, put together in the map tasks, so that what shuffles is a few KB for each trigram and bucket.
    """
    text = docs.select(_place(id_col, text_col, places).alias("p"), base.ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    has = F.array_compact(F.array(*(F.when(F.contains("t", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    one = text.select("p", F.explode(has).alias("trigram"))
    return one.groupBy("trigram", F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def candidates(docs: DataFrame, rules, id_col: str, text_col: str, places: int) -> DataFrame:
    """(bucket, a bitmap of candidate places for each rule that has mandatory trigrams)."""
    wanted = [(r.kind, i, t) for r in rules for i, branch in enumerate(trigram_query(r.regex)) for t in branch]
    trigrams = sorted({t for _, _, t in wanted})
    need = docs.sparkSession.createDataFrame([(trigrams.index(t), k, i, sum(1 for x in wanted if x[:2] == (k, i))) for k, i, t in wanted], "trigram int, kind string, branch int, need long")
    hits = postings(docs, trigrams, id_col, text_col, places).join(F.broadcast(need), "trigram")
    both = hits.groupBy("kind", "branch", "need", "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n")).filter("n = need")
    return both.groupBy("bucket").agg(*(F.bitmap_or_agg(F.when(F.col("kind") == k, F.col("bitmap"))).alias(k) for k in dict.fromkeys(k for k, _, _ in wanted)))


def find_spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, order, end, kind), in code points, end exclusive.

    The pieces between the matches and the matches themselves, in turn, add up to the text.
    """
    rx = F.lit(rule.regex)
    kind = "array<struct<start:int,ord:int,end:int,kind:string>>"
    parts = F.arrays_zip(F.split(text, rule.regex, -1).alias("s"), F.regexp_extract_all(text, rx, F.lit(0)).alias("m"), F.regexp_extract_all(text, rx, F.lit(rule.group)).alias("g"))
    init = F.struct(F.lit(0).alias("p"), F.array().cast(kind).alias("a"))

    def step(acc, x):
        start = acc["p"] + F.char_length(x["s"])
        end = start + F.char_length(x["m"])
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        grown = F.when(F.char_length(x["g"]) >= rule.least, F.concat(acc["a"], F.array(one))).otherwise(acc["a"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.alias("p"), grown.alias("a")))

    return F.when(text.rlike(rule.regex), F.aggregate(parts, init, step)["a"]).otherwise(F.array().cast(kind))


def find_secrets(docs: DataFrame, rules=BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and found, the sorted array of (start, ord, end, kind) over the whole text.

    Rules whose regex has mandatory trigrams are verified only on the rows that the intersected
    postings name, the others (hex) on every text. A null text is empty; ids may be null, strings or
    repeated; repeated rows share their place and are verified alike. Texts of any length are read whole; a text with
    very many matches has them in one array. The candidate bitmaps are broadcast if they fit in base.BROADCAST_BYTES, else joined by a shuffle on
    the place's bucket.
    """
    indexed = [r for r in rules if trigram_query(r.regex) != [frozenset()]]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if indexed:
        places = max(1 << 15, rows.count() * PLACES_A_ROW)
        side = base.stash(candidates(docs, indexed, id_col, text_col, places))
        rows = rows.withColumn("place", _place("id", "text", places))
        rows = rows.join(base.bounded(side, 4200 * len(indexed)), F.bitmap_bucket_number("place") == F.col("bucket"), "left")
    spans = []
    for i, r in enumerate(rules):
        found = find_spans(text, r, i)
        if r in indexed:
            found = F.when(base.bit(F.col(r.kind), F.bitmap_bit_position("place")), found).otherwise(F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>"))
        spans.append(found)
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*spans)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def twin(rules, of: int) -> str:
    """DuckDB SQL of all spans, with counts of the first `of` rules. The pieces between the matches are split off there, too."""
    q = lambda t: "'" + t.replace("'", "''") + "'"
    each = " union all ".join(f"select doc_id, {q(r.kind)} kind, {i} ord, {r.least} least, string_split_regex(t, {q(r.regex)}) s, regexp_extract_all(t, {q(r.regex)}, 0) m, regexp_extract_all(t, {q(r.regex)}, {r.group}) g from d where regexp_matches(t, {q(r.regex)})" for i, r in enumerate(rules))
    listed = lambda where: f"string_agg(concat_ws(':', kind, a, a + n), ',' order by a, ord) {where}"
    return f"""
    with d as (select doc_id, coalesce(text, '') t from documents), r as ({each}), e as (select *, unnest(generate_series(1, len(m))) i from r),
    p as (select doc_id, kind, ord, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) a, length(m[i]) n from e where length(g[i]) >= least),
    f as (select doc_id, {listed('')} spans, {listed(f'filter (ord < {of})')} base, {", ".join(f"count(*) filter (kind = {q(r.kind)}) n_{r.kind}" for r in rules[:of])} from p group by 1)
    select d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) n_{r.kind}" for r in rules[:of])}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join f using (doc_id)
    """


@base.query("op6_secret_scan", twin(BASE_RULES + MORE_RULES, len(BASE_RULES)))
def op6_secret_scan(spark, sf_dir):
    found = find_secrets(base.table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    kinds = [r.kind for r in BASE_RULES]
    ours = F.filter("found", lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *map(of, kinds), F.sha2(_joined(ours), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
