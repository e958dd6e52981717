"""Alignment of two tokenizers' ids by the bytes they share, counted in dense id-striped matrices."""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from . import textbytes as tb

#: Bytes and rows of the texts that make a block; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1024
#: Ids of a stripe: a matrix of STRIPE x (ids of the other side) 64-bit counts is what a task holds, 131 MB for 32,000.
STRIPE = 512
#: Blocks whose links of a stripe go to one task; with more, a stripe is dealt to several tasks, whose counts are added up.
BLOCKS_A_SALT = 1024
#: Pairs of a row of counts.
PIECE = 1 << 16
#: How the byte-level tokenizer cuts a text before it merges; fixed by that public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LINKS = {"stripe": pa.int32(), "codes": pa.binary(), "docs": pa.binary(), "at": pa.binary(), "times": pa.binary()}
_DOCS = {"idx": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}
_TOKENIZED = "kind int, block long, idx int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, codes binary, docs binary, at binary, times binary"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers: ids of whole texts, and each id's bytes."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        byte, special = _byte_of(), {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.size_a = max([*ranks.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.size_b = self.b.vocab_size()
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [piece(i) for i in range(self.size_b)]
        self.len_a = np.zeros(self.size_a, np.int64)
        self.len_a[list(ranks.values())] = [len(t) for t in ranks]
        self.len_b = np.array([len(t) for t in self.bytes_b], np.int64)
        # what stands for an id in the text of groups: A before A, A before B, B before B, B before the next group
        self.says = [f"{i}{end}".encode() for n, ends in ((self.size_a, ",|"), (self.size_b, ",;")) for end in ends for i in range(n)]

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none for an empty text, or if one side's bytes aren't those of a space and the text."""
        none = np.zeros(0, np.int64)
        out = []
        for text, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = b" " + text.encode()
            a = self.a.encode_ordinary(" " + text) if text else []
            same = text and b"".join(map(self.bytes_b.__getitem__, ids)) == whole and self.a.decode_bytes(a) == whole
            out.append((np.array(a, np.int64), np.array(ids, np.int64)) if same else (none, none))
        return out


@functools.cache
def pair(byte_level: str, pieces: str) -> Pair:
    """One for each process."""
    return Pair(byte_level, pieces)


def align(tokens: list[tuple[np.ndarray, np.ndarray]], p: Pair):
    """Of a block's documents: n_a, n_b, n_groups, n_links, texts of groups, and each link's (A id, B id, document).

    Both sides cut the same bytes, so each piece between neighbouring ends of either side is one link, and the pieces up to an end of
    both sides are a group.
    """
    n_a, n_b = (np.array([len(t[i]) for t in tokens], np.int64) for i in (0, 1))
    a, b = (np.concatenate([t[i] for t in tokens] or [np.zeros(0, np.int64)]) for i in (0, 1))
    end_a, end_b = np.cumsum(p.len_a[a]), np.cumsum(p.len_b[b])
    total = int(end_a[-1]) if len(end_a) else 0
    is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    is_a[end_a], is_b[end_b] = True, True
    ends = np.flatnonzero(is_a | is_b)
    of_a, of_b = is_a[ends], is_b[ends]
    both = of_a & of_b
    link_a, link_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    after_a, after_b = np.cumsum(n_a), np.cumsum(n_b)
    last = np.flatnonzero(of_a)[after_a[n_a > 0] - 1]  # the link that ends each document that has any
    closed = np.zeros(len(tokens), np.int64)
    closed[n_a > 0] = np.diff(last, prepend=-1)
    groups_at = np.cumsum(both)
    n_groups = np.zeros(len(tokens), np.int64)
    n_groups[n_a > 0] = np.diff(groups_at[last], prepend=0)
    doc = np.repeat(np.arange(len(tokens)), closed)
    # the text of groups: each side's ids of a group one after the other
    at_a, at_b = np.flatnonzero(of_a), np.flatnonzero(of_b)
    group_a, group_b = groups_at[at_a] - both[at_a], groups_at[at_b] - both[at_b]
    in_a, in_b = (np.bincount(g, minlength=int(groups_at[-1]) if len(ends) else 0) for g in (group_a, group_b))
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + p.size_a * both[at_a]
    codes[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * p.size_a + b + p.size_b * both[at_b]
    text_ends = after_a + after_b
    texts = [b"".join(map(p.says.__getitem__, codes[s:e].tolist()))[:-1] for s, e in zip([0, *text_ends[:-1].tolist()], text_ends.tolist(), strict=True)]
    return n_a, n_b, n_groups, closed, texts, a[link_a], b[link_b], doc


def stripes_of(ids: int) -> int:
    return -(-ids // STRIPE)


def _striped(a: np.ndarray, b: np.ndarray, doc: np.ndarray, p: Pair):
    """(stripe, codes, documents of each, their indexes, times) of a block's links: A id i is row i // stripes of stripe i % stripes, so that frequent ids, whose numbers are low, spread."""
    n, bits = stripes_of(p.size_a), BLOCK_ROWS.bit_length()
    wide = STRIPE * p.size_b
    place = (a % n) * wide + (a // n) * p.size_b + b
    keys, times = np.unique(place << bits | doc, return_counts=True)
    place, doc = keys >> bits, keys & (1 << bits) - 1
    first = np.flatnonzero(np.diff(place, prepend=-1))
    docs = np.diff(first, append=len(place))
    stripe = place[first] // wide
    cut = np.flatnonzero(np.diff(stripe, prepend=-1))
    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(first)], strict=True):
        i, j = first[s], first[e] if e < len(first) else len(place)
        yield int(stripe[s]), (place[first[s:e]] % wide).astype("<u4").tobytes(), docs[s:e].astype("<u2").tobytes(), doc[i:j].astype("<u2").tobytes(), times[i:j].astype("<u4").tobytes()


def _tokenized(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """kind 0: documents with what they know by themselves; kind 1: for each block and stripe its distinct pairs, with the documents of each."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        p, block = pair(byte_level, pieces), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, _, _ in tb.chunks(batch, "text", BLOCK_BYTES, BLOCK_ROWS):
                ids = part.column(part.schema.get_field_index("id"))
                tokens = p([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])
                *counts, texts, a, b, doc = align(tokens, p)
                sha = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                columns = dict(zip(_DOCS, [np.arange(len(ids)), *counts, sha], strict=True))
                yield _rows(0, block, ids, {k: pa.array(v, _DOCS[k]) for k, v in columns.items()}, len(ids))
                if len(doc):
                    columns = list(zip(*_striped(a, b, doc, p), strict=True))
                    yield _rows(1, block, None, {k: pa.array(v, t) for (k, t), v in zip(_LINKS.items(), columns, strict=True)}, len(columns[0]), ids.type)
                block += 1

    def _rows(kind, block, ids, columns, n, id_type=None):
        fields = {"kind": pa.array([kind] * n, pa.int32()), "block": pa.array([block] * n, pa.int64())}
        for name, t in {**_DOCS, **_LINKS}.items():
            fields[name] = columns[name] if name in columns else pa.nulls(n, t)
        fields["id"] = pa.nulls(n, id_type) if ids is None else ids
        return pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))

    return base.map_arrow(docs, run, f"{_TOKENIZED}, id {kind}")


def _counted(rows: DataFrame, keys: list[str], wide: int, parts: int) -> DataFrame:
    """Sums of counts by stripe (and salt), in a dense block at a time: (stripe, salt, codes, counts), at most PIECE pairs in a row.

    rows: keys, codes and counts. What a task holds is one block and a batch, whatever the number of rows of a stripe.
    """

    def run(batches):
        now, block = None, None

        def out():
            codes = np.flatnonzero(block)
            for i in range(0, len(codes), PIECE):
                c = codes[i : i + PIECE]
                yield pa.RecordBatch.from_pylist([{"stripe": now[0], "salt": now[1], "codes": c.astype("<u4").tobytes(), "counts": block[c].astype("<i8").tobytes()}], schema)

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["stripe"], r.get("salt", 0))
                if key != now:
                    if now is not None:
                        yield from out()
                    now, block = key, np.zeros(wide, np.int64)
                np.add.at(block, np.frombuffer(r["codes"], "<u4"), np.frombuffer(r["counts"], "<i8") if r["wide"] else np.frombuffer(r["counts"], "<u2").astype(np.int64))
        if now is not None:
            yield from out()

    schema = pa.schema([("stripe", pa.int32()), ("salt", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])
    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys)
    return base.map_arrow(dealt, run, "stripe int, salt int, codes binary, counts binary")


def _scored(counts: DataFrame, links: DataFrame, wide: int, size_b: int, parts: int) -> DataFrame:
    """(block, best, sums): of each block's documents the part of n_best and count_sum that a stripe gives. Counts and links of a stripe and salt meet in one task, counts first."""

    def run(batches):
        now, block, best = None, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["stripe"], r["salt"]) != now:
                    now, block, best = (r["stripe"], r["salt"]), np.zeros(wide, np.int64), None
                codes = np.frombuffer(r["codes"], "<u4")
                if r["kind"] == 0:
                    block[codes] = np.frombuffer(r["counts"], "<i8")
                    continue
                if best is None:
                    best = block.reshape(-1, size_b).max(axis=1)
                docs, at, times = np.frombuffer(r["counts"], "<u2"), np.frombuffer(r["at"], "<u2"), np.frombuffer(r["times"], "<u4").astype(np.int64)
                count = block[codes]
                is_best = np.repeat(count == best[codes // size_b], docs)
                found = np.zeros((2, int(at.max()) + 1), np.int64)
                np.add.at(found[0], at[is_best], times[is_best])
                np.add.at(found[1], at, times * np.repeat(count, docs))
                out.append({"block": r["block"], "best": found[0].astype("<u4").tobytes(), "sums": found[1].astype("<i8").tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("block", pa.int64()), ("best", pa.binary()), ("sums", pa.binary())])
    both = counts.select(F.lit(0).alias("kind"), "stripe", "salt", F.lit(None).cast("long").alias("block"), "codes", "counts", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("times"))
    both = both.unionByName(links.select(F.lit(1).alias("kind"), "stripe", "salt", "block", "codes", F.col("docs").alias("counts"), "at", "times"))
    dealt = both.repartition(parts, "stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")
    return base.map_arrow(dealt, run, "block long, best binary, sums binary")


def _summed(docs: DataFrame, scores: DataFrame, parts: int) -> DataFrame:
    """Documents with n_best and count_sum: a block's scores are added up, then its documents take theirs."""
    kept = [c for c in ("id", *_DOCS) if c != "idx"]
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        now, best, sums = None, None, None
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
            blocks, best_, sums_ = column("block").to_numpy(), column("best").to_pylist(), column("sums").to_pylist()
            is_doc = column("idx").is_valid().to_numpy(zero_copy_only=False)
            idx = column("idx").fill_null(0).to_numpy()
            rows, n_best, count_sum = np.flatnonzero(is_doc), [], []
            for i in range(batch.num_rows):
                if blocks[i] != now:
                    now, best, sums = blocks[i], np.zeros(BLOCK_ROWS, np.int64), np.zeros(BLOCK_ROWS, np.int64)
                if is_doc[i]:
                    n_best.append(best[idx[i]])
                    count_sum.append(sums[idx[i]])
                else:
                    for into, got in ((best, np.frombuffer(best_[i], "<u4")), (sums, np.frombuffer(sums_[i], "<i8"))):
                        into[: len(got)] += got
            if len(rows):
                found = [column(n).take(pa.array(rows)) for n in kept]
                yield pa.RecordBatch.from_arrays([*found, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*kept, "n_best", "count_sum"])

    none = lambda n: F.lit(None).cast(docs.schema[n].dataType).alias(n)
    both = scores.select("block", *(none(n) for n in ("id", *_DOCS)), "best", "sums")
    both = both.unionByName(docs.select("block", "id", *_DOCS, F.lit(None).cast("binary").alias("best"), F.lit(None).cast("binary").alias("sums")))
    dealt = both.repartition(parts, "block").sortWithinPartitions("block", F.col("idx").asc_nulls_first())
    return base.map_arrow(dealt, run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def _links(docs: DataFrame, byte_level: str, pieces: str) -> tuple[DataFrame, DataFrame, DataFrame, int, int, int]:
    """Stored documents, stored links with their salt, counts by stripe, and the width of a stripe's block, the ids of B, and the parts to deal into."""
    p = pair(byte_level, pieces)
    wide, size_b = STRIPE * p.size_b, p.size_b
    found = base.stash(_tokenized(docs, byte_level, pieces), by="kind")
    known = found.filter("kind = 0").select("block", "id", *_DOCS)
    salts = max(1, -(-known.filter("idx = 0").count() // BLOCKS_A_SALT))
    links = found.filter("kind = 1").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    parts = max(base.partitions(links, 32 << 20), min(salts, 100) * stripes_of(p.size_a) // 4)
    counts = _counted(links.select("stripe", "salt", "codes", F.col("docs").alias("counts"), F.lit(False).alias("wide")), ["stripe", "salt"], wide, parts)
    if salts > 1:
        counts = _counted(counts.select("stripe", "codes", "counts", F.lit(True).alias("wide")), ["stripe"], wide, parts)
    counts = base.stash(counts)
    return known, links, counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), wide, size_b, parts


def alignment(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    byte_level, pieces: files of a byte-level BPE (tokenizers' JSON) and a SentencePiece model, which every executor has. Null and empty texts,
    and texts whose bytes one side changes, have no tokens: zeros and ''. Repeated rows count each for itself.
    Texts are tokenized once, in blocks; a block's distinct (A id, B id) pairs, with the documents of each, go to the stripe of the
    A id, are counted into its dense block, and are scored there. A stripe of many blocks is dealt to several tasks, so that no
    id's links meet in one; its counts, at most a block, are added up. Documents get back two numbers for each stripe. No task holds more than
    a stripe's block, a block of documents and a batch; a text of more than BLOCK_BYTES is whole in its task's memory. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known, links, counts, wide, size_b, parts = _links(rows, byte_level, pieces)
    scores = _scored(counts, links, wide, size_b, parts)
    found = _summed(known, scores, parts)
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def best_pairs(docs: DataFrame, byte_level: str, pieces: str, text_col: str = "text") -> DataFrame:
    """The alignment itself: (a_id, b_id, documents) of each A id's most frequent partners, all of those that tie."""
    _, _, counts, wide, size_b, _ = _links(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), byte_level, pieces)
    n = stripes_of(pair(byte_level, pieces).size_a)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                codes = np.frombuffer(r["codes"], "<u4").astype(np.int64)
                count = np.frombuffer(r["counts"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(codes // size_b * n + r["stripe"]), pa.array(codes % size_b), pa.array(count)], names=["a_id", "b_id", "documents"])

    pairs = base.map_arrow(counts.filter("salt = 0"), run, "a_id long, b_id long, documents long")
    most = pairs.groupBy(F.col("a_id").alias("of")).agg(F.max("documents").alias("most"))
    return pairs.join(most, (F.col("a_id") == F.col("of")) & (F.col("documents") == F.col("most"))).select("a_id", "b_id", "documents")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@base.query("op12_alignment")
def op12_alignment(spark, sf_dir):
    return alignment(base.table(spark, sf_dir, "documents"), *tokenizer_paths())
