"""Substring dedup against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from marlstone.llm import substring_dedup
from marlstone.llm import textbytes as tb

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, w=35):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for (d, _), x in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone |= set(range(i, i + w))
        kept = [y for i, y in enumerate(x) if i not in gone]
        out.append((d, len(x), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.mark.parametrize("chunk", [tb.CHUNK_BYTES, 3000])
def test_against_brute_force(spark, chunk, monkeypatch):
    r = random.Random(3)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passages = [text(n) for n in (34, 35, 36, 52, 53, 80, 400)]
    docs = []
    for i in range(150):
        parts = [text(r.choice((0, 3, 17, 18, 90)))]
        for _ in range(r.choice((0, 1, 1, 2))):
            p = r.choice(passages).split()
            a = r.randrange(0, 3)
            parts += [" ".join(p[a:]), text(r.choice((0, 1, 30)))]
        docs.append((i, "\n".join(parts)))
    docs += [(200, None), (201, ""), (202, "a " * 36), (203, "a " * 35), (204, "b c " * 300), (205, docs[3][1]), (3, docs[3][1]), (None, docs[4][1]), (206, "x" * 100_000), (207, text(20_000) + " é " + passages[3]), (208, " ".join(f"u{i}" for i in range(35))), (209, "\x1f\x85 \x0b" * 40)]
    monkeypatch.setattr(substring_dedup.tb.chunks, "__defaults__", (chunk,))
    df = spark.createDataFrame([(d, t, 7, "n") for d, t in docs], "doc_id long, text string, rid int, hits string").repartition(5)
    assert rows(substring_dedup.remove_repeats(df)) == sorted(brute(docs), key=key)


def test_on_tables_and_empty(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(substring_dedup.op9_substring_dedup(spark, sf)) == sorted(brute(docs), key=key)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeats(df).count() == 0
    one = spark.createDataFrame([("k", "p q")], "doc_id string, text string")
    assert [r.kept_text for r in substring_dedup.remove_repeats(one, keep_text=True).collect()] == ["p q"]


def test_shuffled_sides(spark, monkeypatch):
    """Without any broadcast the result is the same."""
    monkeypatch.setattr(substring_dedup.base, "BROADCAST_BYTES", 0)
    docs = [(i, " ".join(f"w{j}" for j in range(i % 4, 60)) + f" end{i}") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(substring_dedup.remove_repeats(df)) == sorted(brute(docs), key=key)
