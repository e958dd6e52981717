"""Alignment against the plain tokenizers, pair by pair."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import alignment

SF = "/root/testdata/sf0.001"
PATHS = alignment.tokenizer_paths()
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spans(pieces):
    out, at = [], 0
    for i, raw in pieces:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(texts, tokenizers):
    """The contract, token by token."""
    ta, tb = tokenizers
    byte = alignment._byte_of()
    docs, often = [], Counter()
    for t in texts:
        a = [(i, bytes(byte[c] for c in ta.id_to_token(i))) for i in ta.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()) for i in tb.encode(t)] if t else []
        if not t or any(b"".join(x for _, x in side) != (" " + t).encode() for side in (a, b)):
            docs.append(None)
            continue
        a, b = spans(a), spans(b)
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        often.update(set(links))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ";".join(",".join(str(i) for i, _, x in a if s < x <= e) + "|" + ",".join(str(j) for j, _, x in b if s < x <= e) for s, e in zip([0, *ends], ends))
        docs.append((len(a), len(b), len(ends), links, groups))
    best = defaultdict(int)
    for (i, _), n in often.items():
        best[i] = max(best[i], n)
    rows = []
    for d in docs:
        if d is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            links = d[3]
            rows.append((*d[:3], len(links), sum(often[x] == best[x[0]] for x in links), sum(often[x] for x in links), hashlib.sha256(d[4].encode()).hexdigest()))
    return rows, often, best


TEXTS = [
    "", None, " ", "a", "Hello world", "Hello world", "Hello  world ", "naïve café 中文 😀👍🏽", "▁x", "a▁b", "<0x41> <|endoftext|> <s>x</s>", "\n\nline\tone\r\n",
    "x" * 3000, "don't we'll I'VE 12345 ٣٤", "\x00\x01 \x85\xa0 　end", "tail   ", "é ﬁ Ⅷ",
]


def test_edges(spark, tokenizers):
    want, _, _ = plain([t or "" for t in TEXTS], tokenizers)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumns({"id": F.lit("x"), "kind": F.lit(9), "block": F.lit(None), "stripe": F.lit(1)}).repartition(3)
    found = alignment.alignment(df, *PATHS)
    assert dict(found.dtypes)["doc_id"] == "int"
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found.collect()} == dict(enumerate(want))


def test_whole_table(spark, tokenizers):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("text", F.when(F.length("text") < 6000, F.col("text")))
    rows = table.collect()
    want, often, best = plain([r.text or "" for r in rows], tokenizers)
    found = alignment.alignment(table, *PATHS)
    assert sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in found.collect()) == sorted((r.doc_id, *w) for r, w in zip(rows, want, strict=True))
    pairs = {(r.a_id, r.b_id): r.documents for r in alignment.best_pairs(table, *PATHS).collect()}
    assert pairs == {x: n for x, n in often.items() if n == best[x[0]]}


def test_many_blocks_and_salts_change_nothing(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, alignment.alignment(table, *PATHS).collect()))
    monkeypatch.setattr(alignment, "BLOCKS_A_SALT", 3)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 16)
    monkeypatch.setattr(alignment, "PIECE", 100)
    assert sorted(map(tuple, alignment.alignment(table, *PATHS).collect())) == want


def test_empty_table_and_null_ids(spark):
    schema = "doc_id string, text string"
    assert alignment.alignment(spark.createDataFrame([], schema), *PATHS).count() == 0
    found = alignment.alignment(spark.createDataFrame([(None, "one two"), (None, "one two"), ("a", None)], schema), *PATHS).collect()
    assert sorted((r.doc_id or "", r.n_a, r.n_best == r.n_links) for r in found) == [("", 2, True), ("", 2, True), ("a", 0, True)]


def test_ids_equal_the_plain_tokenizer(tokenizers):
    rng = np.random.default_rng(3)
    pool = list(" \t\n\r\x0b\x0c\x1c\x85\xa0᠎ ​　﻿aZ9'sltñ中😀́▁<|>_-.,½٣\x00͸")
    p = alignment.pair(*PATHS)
    texts = ["".join(rng.choice(pool, rng.integers(1, 14))) for _ in range(4000)]
    assert [p.a.encode_ordinary(" " + t) for t in texts] == [tokenizers[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
