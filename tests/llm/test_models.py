"""Language ID, toxicity and language-model scores against brute force and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import base, language, lm_score, toxicity
from marlstone.llm import textbytes as tb

SF = "/root/testdata/sf0.01"
ODD = [(90_001, None), (90_002, ""), (90_003, "12 34 !!"), (90_004, "中文文本"), (90_005, "x" * 300_000), (None, "the and of"), (5, "repeated id")]


def out_of_fold(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_codewords():
    for n in (1, 2, 4, 7, 12):
        c = language.codewords(n)
        assert len(c) == n and len({tuple(x) for x in c}) == n and set(np.unique(c)) <= {-1, 1}
    four = language.codewords(4)
    assert min((four[i] != four[j]).sum() for i in range(4) for j in range(i)) == 4  # one wrong bit of seven is corrected


def test_decoding_corrects_a_bit():
    rows = [(t, k) for k, t in (("a", "kaka lolo mimi "), ("b", "zuzu rere toto "), ("c", "wawa pipi nene "), ("d", "fofo gugu baba ")) for _ in range(5)]
    m = language.Model(rows)
    data, off = tb.buffers(pa.array(["mimi kaka kaka", "zuzu toto"]))
    best, score, unsure = m.decode(data, off)
    assert [m.languages[i] for i in best] == ["a", "b"] and (score > 0.5).all() and (score <= 1).all() and not unsure.any()
    m.offset[0] -= 2 * (m.means(data, off)[0, 0] * m.scale[0] + m.offset[0])  # this bit now says the opposite
    assert m.languages[m.decode(data, off)[0][0]] == "a"


def plain_slots(text):
    """Slots of the 2- and 3-grams of a text's bytes, by the letter of the definition."""
    fold = lambda b: b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    x, out = [fold(b) for b in (text or "").encode()], []
    for n in (2, 3):
        for i in range(len(x) - n + 1):
            if any(b != 32 for b in x[i : i + n]):
                code = 0
                for b in x[i : i + n]:
                    code = code * 256 + b
                out.append(((code + n) * 2654435761 & 0xFFFFFFFF) >> 16)
    return out


def test_language_against_plain_python():
    """Weights from plain counts, and labels and scores from a plain decode over all codewords."""
    r = random.Random(2)
    vocab = {k: ["".join(r.choice(a) for _ in range(4)) for _ in range(30)] for k, a in (("a", "abcde"), ("b", "fghij"), ("c", "aefij"))}
    rows = [(" ".join(r.choice(vocab[k]) for _ in range(12)), k) for k in vocab for _ in range(20)]
    m = language.Model(rows)
    counts = {k: Counter(s for t, y in rows if y == k for s in plain_slots(t)) for k in vocab}
    for bit in range(m.codes.shape[1]):
        side = {s: [k for i, k in enumerate(m.languages) if m.codes[i, bit] == s] for s in (1, -1)}
        for slot in sorted(set().union(*counts.values()))[:50]:
            odds = [math.log((sum(counts[k][slot] / sum(counts[k].values()) for k in side[s]) / len(side[s]) * 1e6 + 0.5) / (1e6 + 0.5 * language.SLOTS)) for s in (1, -1)]
            assert math.isclose(m.weights[slot, bit], odds[0] - odds[1], rel_tol=1e-4, abs_tol=1e-4)
    texts = [t for t, _ in rows[::7]] + ["abc FGH ééé", "zz", "a"]
    best, score, unsure = m.decode(*tb.buffers(pa.array(texts)))
    for t, i, s, u in zip(texts, best, score, unsure, strict=True):
        slots, losses = plain_slots(t), []
        margin = [(sum(float(m.weights[x, b]) for x in slots) / max(1, len(slots))) * m.scale[b] + m.offset[b] for b in range(m.codes.shape[1])]
        for code in m.codes:
            losses.append(sum(w * math.log1p(math.exp(-c * g)) for w, c, g in zip(m.reliable, code, margin, strict=True)) / sum(m.reliable))
        low = sorted(losses)
        assert losses[i] == min(losses) and math.isclose(s, 1 / sum(math.exp((low[0] - x) * len(margin)) for x in losses), rel_tol=1e-5) and u == (low[1] - low[0] < language.AMBIGUOUS)


def test_language_held_out(spark):
    docs = base.table(spark, SF, "documents")
    got = language.op5_language(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(lang) and all(r.held_out == out_of_fold(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert sum(lang[r.doc_id] == r.lang_pred for r in got if r.held_out) >= 0.97 * sum(r.held_out for r in got)


def test_language_learns_only_from_its_fold(spark):
    """Labels of held-out rows change nothing."""
    docs = base.table(spark, SF, "documents").select("doc_id", "text", "lang")
    wrong = docs.withColumn("lang", F.when(base.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = (language.fit(d, rows=30) for d in (docs, wrong))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_language_odd_rows(spark):
    docs = base.table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, rows=30)
    odd = spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id long, text string, score string")
    found, (lang, score, unsure) = language.identify(odd, model)
    got = {r.doc_id: r for r in found.collect()}
    assert [got[i][lang] for i in (90_001, 90_002, 90_003)] == ["und"] * 3 and got[90_003][score] == 0 and got[90_004][lang] != "und" and got[None][lang] == "en" and got[5].score == "clash"
    none = language.fit(docs.limit(0))
    assert {r[0] for r in language.identify(odd, none)[0].select(lang).collect()} == {"und"} and language.identify(odd.limit(0), model)[0].count() == 0
    kept = language.keep_known(docs.unionByName(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))))
    assert kept.columns == docs.columns and kept.count() == docs.count() + 4


def toy(seed=1, n=300):
    r = random.Random(seed)
    bad = ["idiot", "scum", "moron", "vequando", "vequelle"]
    rows = []
    for _ in range(n):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice((5, 40, 200)))]
        y = int(r.random() < 0.25)
        for _ in range(y * 4):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((" ".join(words), y))
    return rows


def test_nearest_is_exact():
    ix = toxicity.Index(toy())
    assert len(ix.terms) and len(ix.labels)
    dense = np.zeros((len(ix.labels), len(ix.terms)))
    for i, (a, b) in enumerate(zip(ix.own[2][:-1], ix.own[2][1:], strict=True)):
        dense[i, ix.own[0][a:b]] = ix.own[1][a:b]
    assert np.allclose((dense**2).sum(1), 1)
    data, off = tb.buffers(pa.array([t for t, _ in toy(2, 80)] + ["idiot idiot scum", "", None]))
    for k in (1, 5, 15):
        for at, w in ix.vectors(data, off):
            q = np.zeros(len(ix.terms))
            q[at] = w
            want = np.round(dense @ q, 12)
            got = ix.nearest(at, w, k)
            order = sorted((i for i in range(len(want)) if want[i] > 0), key=lambda i: (-want[i], i))[:k]
            assert [i for _, i in got] == order and np.allclose([s for s, _ in got], want[order])


def test_toxicity_odd_rows(spark):
    ix = toxicity.Index(toy())
    odd = spark.createDataFrame([(i, t, 1) for i, t in ODD] + [(7, "you IDIOT, scum! moron w1 w2", 1)], "doc_id long, text string, predicted int")
    found, (score, predicted, evidence) = toxicity.rate(odd, ix)
    got = {r.doc_id: r for r in found.collect()}
    assert got[7][predicted] == 1 and got[7][evidence] and got[7].predicted == 1 and all(e.cosine > 0 for e in got[7][evidence])
    assert all(0 <= r[score] < 0.3 and not r[predicted] and not r[evidence] for i, r in got.items() if i != 7)
    empty = toxicity.Index([])
    assert all(0 <= r[score] <= 1 for r in toxicity.rate(odd, empty)[0].collect())
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert not len(toxicity.fit(odd, labels).terms) and toxicity.rate(odd.limit(0), ix)[0].count() == 0


def test_toxicity_scores_against_plain_python():
    """Votes of all examples sorted by cosine, and the isotonic fit by pooling neighbours that violate it."""
    rows = toy(4, 120)
    ix = toxicity.Index(rows)
    dense = np.zeros((len(ix.labels), len(ix.terms)))
    for i, (a, b) in enumerate(zip(ix.own[2][:-1], ix.own[2][1:], strict=True)):
        dense[i, ix.own[0][a:b]] = ix.own[1][a:b]

    def vote(cosines):
        cosines = np.round(cosines, 12)
        near = sorted((i for i in range(len(cosines)) if cosines[i] > 0), key=lambda i: (-cosines[i], i))[: toxicity.NEIGHBOURS]
        toxic = sum(cosines[i] * ix.weight[1] for i in near if ix.labels[i])
        return (toxic + 0.5 * ix.prior) / (toxic + sum(cosines[i] * ix.weight[0] for i in near if not ix.labels[i]) + 0.5), near

    votes = []
    for i, x in enumerate(dense):
        x = np.where((dense > 0).sum(0) > 1, x, 0)
        cosines = dense @ (x / max(np.sqrt((x**2).sum()), 1e-300))
        cosines[i] = 0
        votes.append(vote(cosines)[0])
    pools = [[v * ix.weight[y], y * ix.weight[y], ix.weight[y]] for v, y in sorted(zip(votes, ix.labels, strict=True), key=lambda x: x[0])]
    k = 0
    while k < len(pools) - 1:
        if pools[k][1] / pools[k][2] >= pools[k + 1][1] / pools[k + 1][2]:
            pools[k] = [a + b for a, b in zip(pools[k], pools.pop(k + 1), strict=True)]
            k = max(0, k - 1)
        else:
            k += 1
    grid, fit = [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]
    data, off = tb.buffers(pa.array([t for t, _ in toy(9, 40)] + [""]))
    queries = list(ix.vectors(data, off))
    for (at, w), (score, found) in zip(queries, ix.scores(queries), strict=True):
        q = np.zeros(len(ix.terms))
        q[at] = w
        v, near = vote(dense @ q)
        assert [i for _, i in found] == near and math.isclose(score, np.interp(v, grid, fit) if near else ix.prior, abs_tol=1e-9)


def test_unlike_texts_of_common_words_stay_examples():
    """Labelled texts that share words, and copies too, are all examples."""
    rows = [(f"the same few words {i}", i % 2) for i in range(40)] + [("copy", 0)] * 3
    assert len(toxicity.Index(rows).labels) == 43


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, sf).collect()}
    labels = [r for r in base.table(spark, sf, "labels").collect() if out_of_fold(r.doc_id)]
    assert all(got[r.doc_id].held_out for r in labels)
    hit = sum(r.toxic and got[r.doc_id].predicted for r in labels)
    assert hit >= 0.8 * sum(r.toxic for r in labels) and hit >= 0.8 * sum(got[r.doc_id].predicted for r in labels)


def brute_lm(docs, good):
    """The same two models by plain counting, on the same slots."""
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for i, t in docs}
    flat = sorted({w for x in words.values() for w in x})
    data, off = tb.buffers(pa.array(flat))
    h = dict(zip(flat, tb.tokenize(data, off, tb.ALNUM).hash.tolist(), strict=True))
    slot = lambda w: 0 if w is None else h[w] & (lm_score.WORDS - 1)

    def pair(a, b):
        x = np.array([(0 if a is None else h[a]) * 0x9E3779B97F4A7C15 + h[b] & (1 << 64) - 1], np.uint64)
        return int(tb.mix(x)[0]) & (lm_score.PAIRS - 1)

    c = [[Counter(), Counter(), Counter()] for _ in range(2)]
    for i, x in words.items():
        for m in (0, 1):
            if m == 1 or i in good:
                for a, b in zip([None, *x], x, strict=False):
                    c[m][0][slot(b)] += 1
                    c[m][1][slot(a)] += 1
                    c[m][2][pair(a, b)] += 1
    n = [sum(m[0].values()) for m in c]
    scale = [1.0, n[0] / n[1]]
    out = {}
    for i, x in words.items():
        ce = []
        for m in (0, 1):
            total = 0.0
            for a, b in zip([None, *x], x, strict=False):
                p = (c[m][0][slot(b)] * scale[m] + lm_score.PRIOR_WORD / lm_score.WORDS) / (n[m] * scale[m] + lm_score.PRIOR_WORD)
                seen = c[m][1][slot(a)] * scale[m]
                total -= math.log((min(c[m][2][pair(a, b)] * scale[m], seen) + lm_score.PRIOR_PAIR * p) / (seen + lm_score.PRIOR_PAIR))
            ce.append(total / len(x) if x else None)
        out[i] = (len(x), *ce)
    return out


def test_lm_against_counting(spark):
    docs = [(r.doc_id, r.text) for r in base.table(spark, "/root/testdata/sf0.001", "documents").collect()][:60] + [(i, t) for i, t in ODD if i and i > 5]
    good = {i for i, _ in docs if i % 3 == 0}
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double").repartition(3)
    found, (n, ct, cb, score) = lm_score.score(df, spark.createDataFrame([(i,) for i in [*good, None]], "k long"))
    want = brute_lm(docs, good)
    got = found.collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert r[n] == w[0]
        if w[0]:
            assert r[ct] == pytest.approx(w[1], rel=1e-5) and r[cb] == pytest.approx(w[2], rel=1e-5) and r[score] == pytest.approx(r[ct] - r[cb])
        else:
            assert r[ct] is None and r[score] is None


def test_lm_tells_targets_apart(spark):
    r = random.Random(0)
    text = lambda v: " ".join(r.choice(v) for _ in range(60))
    a, b = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    df = spark.createDataFrame([(i, text(a if i % 2 else b)) for i in range(100)], "doc_id long, text string")
    found, (*_, score) = lm_score.score(df, df.filter("doc_id % 2 = 1 and doc_id < 50").select("doc_id"))
    s = {x.doc_id: x[score] for x in found.collect()}
    assert max(s[i] for i in s if i % 2) < min(s[i] for i in s if not i % 2)
    assert lm_score.score(df.limit(0), df.select("doc_id"))[0].count() == 0
    assert all(math.isfinite(x[score]) for x in lm_score.score(df, df.limit(0).select("doc_id"))[0].collect())


def test_all_terms_are_indexed(spark):
    """A word of one toxic example, and words that don't tell the labels apart, are terms; the idf follows all documents."""
    rows = [(f"plain w{i} w{i + 1}", 0) for i in range(40)] + [("plain onlyhere w3", 1)]
    ix = toxicity.Index(rows)
    (at, w), *_ = ix.vectors(*tb.buffers(pa.array(["onlyhere"])))
    assert [ix.labels[i] for _, i in ix.nearest(at, w)] == [1] and len(ix.terms) > 41
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(i, "onlyhere") for i in range(100, 150)] + [(200, None)], "doc_id long, text string").repartition(3)
    n, df = toxicity.spread(docs, "text", ix.terms)
    k = np.searchsorted(ix.terms, tb.tokenize(*tb.buffers(pa.array(["onlyhere", "plain"])), tb.ALNUM).hash)
    assert n == 92 and df[k].tolist() == [51, 41]


def test_distinct_pairs_stay_apart(spark):
    """Words whose hashes agree in their 20 low bits are counted apart, and so are their pairs."""
    words = [f"q{i}" for i in range(6000)]
    h = tb.tokenize(*tb.buffers(pa.array(words)), tb.ALNUM).hash & np.uint64((1 << 20) - 1)
    first: dict = {}
    a, b = next((first[x], w) for w, x in zip(words, h.tolist(), strict=True) if first.setdefault(x, w) != w)
    df = spark.createDataFrame([(i, f"{a} {a} {a}") for i in range(20)] + [(50, f"{b} {b} {b}")], "doc_id long, text string")
    found, (n, target, every, _) = lm_score.score(df, df.filter("doc_id < 20").select("doc_id"))
    got = {r.doc_id: r for r in found.collect()}
    assert got[50][n] == 3 and got[50][target] > got[0][target] + 5 and got[50][every] > got[0][every] + 1


def test_hot_id_leaves_room_for_others(spark, monkeypatch):
    """An id that stands on very many rows is one row of what classifiers are fitted on."""
    rows = [(1, f"hot {i}", "a") for i in range(900)] + [(i, f"text {i}", "b") for i in (5, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "Model", lambda rows: rows)
    got = Counter(lang for _, lang in language.fit(docs, rows=2))
    assert got == {"a": 1, "b": 2}
    monkeypatch.setattr(toxicity, "Index", lambda rows, *_: rows)
    labels = spark.createDataFrame([(1, 0), (5, 1), (8, 1), (9, 1), (10, 1)], "doc_id long, toxic int")
    assert Counter(y for _, y in toxicity.fit(docs, labels, most=2)) == {0: 1, 1: 2}
