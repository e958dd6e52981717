"""Quality rules: measures against plain loops, cutoffs against plain binomial sums."""

import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string"


def plain(text):
    """The contract's base measures."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    n, repeated = len(words), len(hit)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n


TEXTS = [
    None, "", " \t\n", "a", "a b c d e", "a b c d e a b c d e", "a a a a a a", "a a a a a", "x\ny\nx\n \n \nx", "#*$%&|<> < >", "naïve 日本 😀 x y\x0bz\x1cw",
    "\n".join(["one two three four five six"] * 4), " ".join(str(i % 40) for i in range(300)), "a b c d e f g h a b c d e x y z q a b c d e f", "word " * 3 + "end", "\r\na\r\nb\r\na",
]


def measured(spark, texts):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA).withColumns({"id": F.lit(1), "n_words": F.lit("x"), "w": F.lit(2), "stratum": F.lit(0)}).repartition(3)
    out = Q.judge(df, spark.createDataFrame([], "doc_id long, quality int"))
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()}


def test_measures(spark):
    long = " ".join(random.Random(1).choices("abcdefghij", k=30_000))
    texts = [*TEXTS, long]
    assert measured(spark, texts) == {i: plain(t) for i, t in enumerate(texts)}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=60), min_size=20, max_size=40))
def test_measures_of_any_text(spark, texts):
    assert measured(spark, texts) == {i: plain(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 5, 40, 3000) for p in (0.01, 0.05, 0.3) for k in (0, 1, 2, 7, 30) if k <= n * p]
    want = [sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) for k, n, p in cases]
    for (k, n, p), w in zip(cases, want, strict=True):
        got = spark.range(1).select(Q.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("t")).first().t
        assert math.isclose(got, w, rel_tol=1e-9)
    assert spark.range(1).select(Q.binomial_tail(F.lit(9).cast("long"), F.lit(10).cast("long"), 0.1).alias("t")).first().t == 1.0


def corpus(spark):
    """Good documents of two languages; symbols mark bad ones in both, but in 'b' a sixth of the good ones too."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(4000):
        lang, good = "ab"[i % 2], rng.random() < 0.8
        text = " ".join("w%d" % rng.randrange(10**6) for _ in range(20))
        if not good or lang == "b" and rng.random() < 1 / 6:
            text += " $$$$" * 4
        docs.append((i, text, lang))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"), docs, dict(labels)


def test_cutoffs_keep_the_risk(spark):
    docs, labels, rows, label = corpus(spark)
    out = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    bad = {lang: [out[i].kept for i, _, x in rows if x == lang and not label[i]] for lang in "ab"}
    lost = {lang: sum(not out[i].kept for i, _, x in rows if x == lang and label[i]) / sum(label[i] for i, _, x in rows if x == lang) for lang in "ab"}
    assert not any(bad["a"]) and all(bad["b"])  # in b no cutoff can hold
    assert max(lost.values()) <= Q.RISK
    assert {r.rejected_by for r in out.values()} == {"", "symbols"}


def test_cutoffs_equal_plain_sums(spark):
    docs, labels, rows, label = corpus(spark)
    known = Q.measures(docs, keep=("lang",)).join(labels.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    got = {r.stratum: list(r.steps) for r in Q.cutoffs(known, "lang").collect()}
    tests, p = 2 * len(Q.RULES), Q.RISK / len(Q.RULES)
    for lang in "ab":
        base = [plain(t) for i, t, x in rows if x == lang and label[i]]
        base = [dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), b), n_lines=1) for b in base if not b[-1]]
        for r, step in zip(Q.RULES, got[lang], strict=True):
            want = 0
            for c in r.cutoffs:
                k = sum(100 * b[r.part] > c * b[r.whole] if r.above else 100 * b[r.part] < c * b[r.whole] for b in base)
                n = len(base)
                if k > n * p or sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > Q.FAILURE / tests:
                    break
                want += 1
            assert step == want, (lang, r.name)


def test_labels_ties_and_null_strata(spark):
    docs = spark.createDataFrame([(1, "a " * 4, None), (1, " ".join(map(str, range(30))), None), (None, " ".join(map(str, range(30))), "x")], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (7, 1), (1, None)], "doc_id long, quality int")
    out = Q.judge(docs, labels)
    assert sorted((r.doc_id or 0, r.kept) for r in out.collect()) == [(0, True), (1, False), (1, True)]
    assert Q.keep_good(docs, labels).columns == docs.columns and Q.keep_good(docs, labels).count() == 1
    assert Q.judge(docs.limit(0), labels).count() == 0
    assert Q.judge(docs, labels, stratum=None).count() == 3


def test_native(spark):
    plan = Q.op11_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
