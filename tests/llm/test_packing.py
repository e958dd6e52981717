"""Packing: exact ids, every id in one piece, little padding; differencing against its bounds."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import packing

tokenizers = pytest.importorskip("tokenizers")
ENCODER = packing.Encoder(packing.tokenizer_path())
PLAIN = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
ALPHABET = list("aAbZ'stelvd019 \n\t.,!?-_é") + ["É", "ß", "İ", "Σ", "ǆ", "́", "\xa0", "\x1c", "\x85", " ", "中", "😀", "µ", "ª", "²", "<|endoftext|>", "'ll", "\x00", "ﬁ", "가", "ᄀ", "ᅡ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), min_size=1, max_size=4))
def test_ids(texts):
    for t, ids in zip(texts, ENCODER(texts), strict=True):
        assert ids.tolist() == [*PLAIN.encode(t, add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=40))
def test_pack_fits(sizes):
    windows = packing.pack(sizes)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 2048 for w in windows)


def test_differencing_is_even():
    r = np.random.default_rng(0)
    for k in (2, 7, 60):
        sizes = r.integers(1, 512, 12 * k).tolist()
        sums = [sum(sizes[i] for i in w) for w in packing.karmarkar_karp(sizes, k)]
        assert len(sums) == k and max(sums) - min(sums) <= 20
    assert packing.karmarkar_karp([8, 7, 6, 5, 4], 2) and sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.karmarkar_karp([8, 7, 6, 5, 4], 2)) == [14, 16]


def check(rows, texts):
    """rows: of the result; texts: by id, each once."""
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for i, t in texts.items():
        ids, at = np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes())) and r.length > 0
            at += r.length
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(r.length for r in rows) / (2048 * len(seqs))


def test_registered(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(packing.op7_packing(spark, sf).collect(), texts) > 0.98


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "a", 4: "x" * 5000, 5: "w " * 10_000, 6: "<|endoftext|> a", None: "null id"}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, offset int")
    check(packing.pack_documents(df, packing.tokenizer_path()).collect(), texts)
    assert packing.pack_documents(df.limit(0), packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("kind", ["int", "smallint", "decimal(12,0)", "string", "date", "bigint"])
def test_ids_keep_their_type(spark, kind):
    value = "date_add(date'2020-01-01', cast(id as int))" if kind == "date" else f"cast(id as {kind})"
    df = spark.range(5).selectExpr(f"{value} as doc_id", "if(id = 3, null, 'one two three') as text").unionByName(spark.sql(f"select cast(null as {kind}) as doc_id, 'x' as text"))
    out = packing.pack_documents(df, packing.tokenizer_path())
    assert dict(out.dtypes)["doc_id"] == kind
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in df.collect())
    assert packing.pack_documents(df.limit(0), packing.tokenizer_path()).count() == 0


def test_letters_are_encoded_once(monkeypatch):
    encoder, asked = packing.Encoder(packing.tokenizer_path()), []
    real = encoder._letters
    monkeypatch.setattr(encoder, "_letters", lambda words: asked.append(sorted(words)) or real(words))
    texts = ["Kestrel, rover", "kestrel rover! KESTREL", "Rover.", "kestrel rover\x1fx", "", "k" * 60 + " rover"]
    for limit in (packing._CACHE_WORDS, 3):
        monkeypatch.setattr(packing, "_CACHE_WORDS", limit)
        for t in texts:
            (ids,) = encoder([t])
            assert ids.tolist() == [*PLAIN.encode(t, add_special_tokens=False).ids, 1]
    assert asked[:3] == [["kestrel", "rover"], [], []]
    assert "k" * 60 not in encoder.known and len(encoder.known) < 9


def test_few_words_are_encoded_at_once(monkeypatch):
    """What the tokenizer takes for a word is hundreds of bytes: a chunk of unlike words goes to it in portions."""
    encoder, asked = packing.Encoder(packing.tokenizer_path()), []
    for name in ("_letters", "_apart"):
        monkeypatch.setattr(encoder, name, lambda words, real=getattr(encoder, name): asked.append(len(words)) or real(words))
    texts = [" ".join(f"w{i}x" for i in range(40_000)), None, " ".join("".join("abcdefghij"[int(c)] for c in str(i)) for i in range(40_000)), ""]
    for t, ids in zip(texts, encoder(texts), strict=True):
        assert ids.tolist() == [*PLAIN.encode(t or "", add_special_tokens=False).ids, 1]
    assert sum(asked) >= 80_000 and max(asked) <= 1 << 14


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), min_size=1, max_size=12), st.integers(1, 9), st.integers(1, 9), st.integers(0, 3))
def test_portions(texts, learnt, joined, skipped):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "LEARNT", learnt)
        m.setattr(packing, "JOINED", joined)
        found = packing.Encoder.__call__(ENCODER, packing.pa.array(texts, packing.pa.string()).slice(skipped))
    for t, ids in zip(texts[skipped:], found, strict=True):
        assert ids.tolist() == [*PLAIN.encode(t or "", add_special_tokens=False).ids, 1]
