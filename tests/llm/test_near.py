"""Near-duplicate classes against all pairs, and the signature against its definition."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import base, near_dedup
from marlstone.llm import textbytes as tb

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sets(t):
    w = ALNUM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    s = [sets(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    out = {}
    for i in range(len(docs)):
        out.setdefault(find(i), []).append(docs[i][0])
    return sorted(sorted(x) for x in out.values())


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    docs = []
    for _ in range(40):
        base = text(r.choice((30, 120, 400)))
        for _ in range(r.choice((1, 1, 2, 6))):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 3))):
                w[r.randrange(len(w))] = word()
            docs.append(" ".join(w))
    passage = text(100)
    docs += [" ".join(passage + text(k)) for k in range(0, 60, 3)]  # some of them linked, some not
    chain = text(200)
    docs += [" ".join(chain[k : k + 130]) for k in range(0, 60, 6)]  # neighbours are linked, the ends are not
    docs += [docs[0].upper() + "!", docs[0], "", None, "one two", "One, two", "!!", "x", "y " * 4000]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 4])
def test_classes(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = corpus()
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, kept string, rid int")
    got = near_dedup.near_classes(df).collect()
    assert len(got) == len(docs)
    classes = {}
    for x in got:
        classes.setdefault(x.class_id, []).append(x.doc_id)
        assert x.kept == (x.doc_id == x.class_id)
    assert all(min(v) == k for k, v in classes.items())
    assert sorted(sorted(v) for v in classes.values()) == brute(docs)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(classes)


def test_ids_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("b", text), ("a", text + " more"), (None, text), ("b", text), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = near_dedup.near_classes(df).collect()
    assert sorted(str(x.class_id) for x in got) == ["None"] * 4 + ["c"]  # a null id is smallest
    assert near_dedup.near_classes(df.limit(0)).count() == 0 and near_dedup.keep_one(df.limit(0)).count() == 0


def test_signature_estimates_probability_jaccard():
    r = np.random.default_rng(2)
    h = tb.mix(np.arange(1, 301, dtype=np.uint64))
    a, b = r.uniform(0.2, 3, 300), r.uniform(0.2, 3, 300)
    a[:60], b[240:] = 0, 0
    hits = []
    for seed in range(60):
        x = tb.mix(h + np.uint64(seed * 1_000_003))
        (ia, ib) = np.flatnonzero(a > 0), np.flatnonzero(b > 0)
        order = [np.argsort(x[i]) for i in (ia, ib)]
        doc = np.concatenate([np.zeros(len(ia), int), np.ones(len(ib), int)])
        sig = near_dedup.signatures(doc, np.concatenate([x[ia][order[0]], x[ib][order[1]]]), np.concatenate([a[ia][order[0]], b[ib][order[1]]]), 2)
        assert (sig != 0).all()
        hits.append((sig[0] == sig[1]).mean())
    both = np.flatnonzero((a > 0) & (b > 0))
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    assert abs(np.mean(hits) - want) < 0.02


def test_repeated_rows_leave_one(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text + " more"), (3, None), (3, None), (4, "other text"), (None, "x"), (None, "x"), (5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (base.BROADCAST_BYTES, 0):
        monkeypatch.setattr(base, "BROADCAST_BYTES", limit)
        kept = [tuple(r) for r in near_dedup.keep_one(df).collect()]
        assert sorted(kept, key=str) == sorted([(1, text), (3, None), (4, "other text"), (None, "x"), (5, "y")], key=str)


def test_semi_first_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(base, "BROADCAST_BYTES", 0)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(2000)], "k long, maybe string")
    side = base.stash(spark.createDataFrame([(i, -i) for i in range(0, 4000, 7)], "k long, v long"))
    assert sorted(base.semi_first(rows, side, "k").collect()) == [(i, f"t{i}", -i) for i in range(0, 2000, 7)]
    left = base.semi_first(rows, side, "k", how="left").collect()
    assert sorted((r.k, r.maybe, r.v) for r in left if r.v is not None) == [(i, f"t{i}", -i) for i in range(0, 2000, 7)] and len(left) == 2000


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 10), (4, 3), (20, 21), (21, 22), (20, 22)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    got = {x.node: x.root for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {2: 1, 3: 1, 4: 1, 10: 9, 21: 20, 22: 20} | {k: 100 for k in range(101, 140)} | {k: 200 for k in range(201, 231)}
    assert got == want


def test_repeated_passage_keeps_its_bands():
    """Near copies of which one repeats a passage 50 times agree on a band."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    texts = []
    for _ in range(100):
        passage, rest, other = ([word() for _ in range(n)] for n in (24, 80, 8))
        texts += [" ".join(passage * 50 + rest), " ".join(passage * 2 + rest[:-8] + other)]
    assert (near_dedup.jaccard(pa.array(texts[::2]), pa.array(texts[1::2])) > near_dedup.SIMILAR).all()
    ids = pa.array(range(len(texts)), pa.int64())
    signed = near_dedup._sign([pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["id", "rid", "text"])])
    bands = [b for out in signed for b in out.column(4).to_pylist()]
    assert all(set(a) & set(b) for a, b in zip(bands[::2], bands[1::2], strict=True))


def test_large_bucket_keeps_a_link_of_one_band(spark, monkeypatch):
    """Of a bucket larger than BLOCK, two alike texts that share no other band, and whose smallest set is like neither."""
    r = random.Random(7)
    word = lambda: f"w{r.randrange(10**6)}"
    one = [word() for _ in range(104)]

    def near(places, last, n):
        out = []
        for _ in range(n):
            w = list(one)
            for i in r.sample(range(len(w)), places):
                w[i] = word()
            out.append(" ".join(w[:last] + [word() for _ in range(2)]))
        return out

    def bands(texts):
        doc, h, _ = near_dedup.shingles(tb.tokenize(*tb.buffers(pa.array(texts)), tb.ALNUM))
        return near_dedup.bands(near_dedup.signatures(doc, h, np.ones(len(h)), len(texts)))

    alike = lambda a, texts: near_dedup.jaccard(pa.array([a] * len(texts)), pa.array(texts))
    text = " ".join(one)
    own = bands([text])[0]
    found = []
    while not found:
        tried = near(2, None, 2000)
        found = [(t, b) for t, b, s in zip(tried, bands(tried) == own, alike(text, tried), strict=True) if b.sum() == 1 and s >= near_dedup.SIMILAR]
    other, same = found[0]
    tried = near(4, 90, 2000)
    fillers = [t for t, b, s, o in zip(tried, bands(tried) == own, alike(text, tried), alike(other, tried), strict=True) if b[same][0] and max(s, o) < near_dedup.SIMILAR][:12]
    assert len(fillers) == 12
    docs = list(enumerate([*fillers, text, other]))
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    classes, df = {}, spark.createDataFrame(docs, "doc_id long, text string")
    for x in near_dedup.near_classes(df).collect():
        classes.setdefault(x.class_id, []).append(x.doc_id)
    want = brute(docs)
    assert any({12, 13} <= set(x) for x in want)
    assert sorted(sorted(v) for v in classes.values()) == want
    assert near_dedup.keep_one(df).count() == len(want)  # the pipeline's stage


def classes_of(docs):
    found = {}
    for x in near_dedup.near_classes(docs).collect():
        found.setdefault(x.class_id, []).append(x.doc_id)
    return sorted(sorted(v) for v in found.values())


def test_a_link_without_a_band(spark):
    """Sets of similarity 0.8 that share no band are linked, too."""
    docs = []
    for seed in (40646, 66154):
        r = random.Random(seed)
        w = [f"w{r.randrange(10**6)}" for _ in range(49)]
        docs += [" ".join(w), " ".join(w[:24] + ["other"] + w[25:]), " ".join(w[:20] + ["some", "others"] + w[22:])]
    texts = pa.array(docs)
    doc, h, _ = near_dedup.shingles(tb.tokenize(*tb.buffers(texts), tb.ALNUM))
    bands = near_dedup.bands(near_dedup.signatures(doc, h, np.ones(len(h)), len(docs)))
    assert not set(bands[0]) & set(bands[1]) and not set(bands[3]) & set(bands[4])
    docs = list(enumerate(docs))
    assert {0, 1} <= set(brute(docs)[0])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert classes_of(df) == brute(docs)
    assert near_dedup.keep_one(df).count() == len(brute(docs))  # the pipeline's stage


@pytest.mark.parametrize("limit", [base.BROADCAST_BYTES, 0])
def test_rare_shingles_find_all_links(spark, monkeypatch, limit):
    """All links are found by the buckets of rare shingles alone, without a band."""
    compared, calls = near_dedup._compared, []

    def second_only(members, root, texts):
        calls.append(1)
        return compared(members, root, texts) if len(calls) == 2 else root

    monkeypatch.setattr(base, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(near_dedup, "_compared", second_only)
    monkeypatch.setattr(near_dedup, "_stars", lambda members, texts: base.stash(members.select("node", "least").filter("false").toDF("a", "b")))
    docs = corpus(11)
    docs += [(len(docs) + i, t) for i, t in docs[:10]]
    assert classes_of(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
