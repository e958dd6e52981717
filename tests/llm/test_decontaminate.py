"""Words, rolling hashes and decontamination against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import decontaminate
from marlstone.llm import textbytes as tb

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAzZ09 \t\n\x00\x1f\x7f-_éß中 😀"), max_size=20)), max_size=6))
def test_words(texts):
    data, offsets = tb.buffers(pa.array(texts, pa.string()))
    for kind, rx, f in ((tb.ALNUM, ALNUM, lower), (tb.SPACED, SPACED, lambda t: t or "")):
        words = tb.tokenize(data, offsets, kind, (2,))
        want = [rx.findall(f(t)) for t in texts]
        assert words.counts.tolist() == [len(x) for x in want]
        flat = [w for x in want for w in x]
        assert [bytes(kind.fold[data[a:b]]).decode() for a, b in zip(words.start, words.end, strict=True)] == flat
        seen = {}
        for w, h in zip(flat, words.hash.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_rolling_and_long_words(monkeypatch):
    monkeypatch.setattr(tb, "_PIECE", 64)
    texts = ["ab " * 50, "x" * 500 + " ab ab", None, "ab ab ab"]
    data, offsets = tb.buffers(pa.array(texts))
    words = tb.tokenize(data, offsets, tb.SPACED)
    assert words.counts.tolist() == [50, 3, 0, 3] and len(set(words.hash.tolist())) == 2
    for n in (1, 2, 3, 60):
        r, ok = tb.rolling(words.hash, n), tb.window_starts(words.first, n)
        seq = words.hash.tolist()
        assert len(r) == len(ok) and [r[i] == r[j] for i in range(0, len(r), 7) for j in range(len(r))] == [seq[i : i + n] == seq[j : j + n] for i in range(0, len(r), 7) for j in range(len(r))]
        doc = words.doc
        assert ok.tolist() == [doc[i] == doc[i + n - 1] for i in range(len(r))]


def brute(docs, items):
    windows = {}
    for k, t in items:
        w = ALNUM.findall(lower(t))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if k is None else str(k))
    out = []
    for d, t in docs:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def case():
    r = random.Random(7)
    vocab = [f"w{i}é" for i in range(6)] + [f"v{i}" for i in range(40)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice((3, 12, 13, 20, 40)))) for i in range(25)] + [(25, None), (26, ""), (2, text(15)), (None, text(14)), (100, "--"), (27, "solo")]
    docs = []
    for i in range(120):
        t = text(r.choice((0, 2, 12, 13, 60, 300)))
        if i % 3:
            other = (r.choice(items)[1] or "").upper().split()
            cut = r.randrange(0, 3)
            t = t + ". " + "!! ".join(other[cut:]) + "; " + text(r.choice((0, 100)))
        docs.append((i, t))
    return docs + [(120, None), (121, ""), (5, docs[5][1]), (None, items[3][1]), (122, "Solo"), (123, text(30_000) + " " + items[4][1])], items


@pytest.mark.parametrize("broadcast", [decontaminate.base.BROADCAST_BYTES, 0])
def test_decontaminate(spark, case, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate.base, "BROADCAST_BYTES", broadcast)
    docs, items = case
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_words int, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked, (n_words, n_hit, found, _) = decontaminate.mark(df, bench)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r[n_words], r[n_hit], len(r[found]), hashlib.sha256(",".join(sorted(r[found])).encode()).hexdigest()) for r in marked.collect())
    assert got == sorted((d if d is not None else -1, *x) for d, *x, _ in brute(docs, items))
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == sum(not x[-1] for x in brute(docs, items))


def test_full_filter(spark, case, monkeypatch):
    """A filter that lets everything through, as one of too few bits would, changes no result."""
    docs, items = case
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.Filter, "__call__", lambda self, prints: np.ones(len(prints), bool))
    marked, (_, n_hit, *_) = decontaminate.mark(df, bench)
    assert sorted(r[n_hit] for r in marked.collect()) == sorted(x[2] for x in brute(docs, items))


def test_words_of_one_polynomial(spark):
    """The words of 1,024 letters that follow the Thue-Morse sequence and its complement are not the same."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ k] for x in bits) for k in (0, 1))
    df, bench = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), spark.createDataFrame([(1, a)], "item_id long, text string")
    marked, (_, n_hit, *_) = decontaminate.mark(df, bench)
    assert {r.doc_id: r[n_hit] for r in marked.collect()} == {1: 1, 2: 0}


def test_winnow_guarantee():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 400).astype(np.uint64)
    low = decontaminate.winnow(h)
    grams = tb.rolling(h, decontaminate.K)
    assert low.tolist() == [grams[i : i + 9].min() for i in range(len(h) - 12)]


def test_registered_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(tuple(r) for r in decontaminate.op2_decontaminate(spark, sf).collect()) == sorted(brute(docs, items))
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.drop_contaminated(df, none).count() == 1 and decontaminate.drop_contaminated(df.limit(0), none).count() == 0
