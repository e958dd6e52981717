"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import functools
import heapq
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from . import textbytes as tb

#: Tokens of a sequence, and of the largest piece that is packed with others.
CAPACITY, PIECE = 2048, 512
#: Windows that are packed together, and tokens that are left free in each for their differences.
WINDOWS, SLACK = 128, 3
#: Bytes of text that are encoded together.
TOGETHER = 4 << 20
#: Words that are encoded together, and words whose ids are put together at once: what both take for each word is hundreds of bytes.
LEARNT, JOINED = 1 << 14, 1 << 17
#: The id that ends a document.
END_ID = 1
#: Words that are kept, and the characters of the longest: 250 bytes each at most, 125 MB in a process.
_CACHE_WORDS, _CACHE_LENGTH = 500_000, 40
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Members of k windows with nearly equal sums.

    Each size begins as a partial partition of its own. The two partitions of the widest spread merge, the
    largest window of one with the smallest of the other, until one is left. Windows that are still empty are not stored.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)  # so many windows get something of both
        both = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
        merged = a[: len(a) - over] + b[: len(b) - over] + both
        merged.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), tie, merged))
        tie += 1
    return [_leaves(tree) for _, tree in heap[0][2]] if heap else []


def _leaves(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        todo.extend(x) if isinstance(x, tuple) else out.append(x)
    return out


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most capacity; their number rises until the largest fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = karmarkar_karp(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += 1


class Encoder:
    """Ids of whole texts, as little-endian uint32.

    The pre-tokenizer drops white space and cuts between letters and other signs, and no token crosses these cuts. So words
    are encoded apart, each distinct one of the texts once, and frequent ones once. Words of plain Latin letters, with or without closing signs, are put
    together from their lower-cased letters and the signs; all others go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _apart(self, words: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Of words of letters only, each of which ends where a token does that ends a word: all in one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cut) != len(words):
            return self._apart(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)] if words else []

    def _learn(self, new: list[str]) -> list[str]:
        """Makes words known, and the letters that plain ones are put together from, which are returned."""
        known, cut, other = self.known, [], []
        for w in new:
            if m := _PLAIN.fullmatch(w):
                cut.append((w, m[1].lower(), m[2]))
            else:
                other.append(w)
        known.update(zip(other, self._apart(other), strict=True))
        letters, signs = list({a for _, a, _ in cut}.difference(known)), list({b for _, _, b in cut})
        known.update(zip(letters, self._letters(letters), strict=True))
        end = dict(zip(signs, self._apart(signs), strict=True))
        for w, a, b in cut:
            known[w] = known[a] + end[b] if b else known[a]
        return letters

    def __call__(self, texts: pa.Array | list) -> list[np.ndarray]:
        """Ids of each text and END_ID; null is empty. Words end at ASCII white space; what other white space is in them the tokenizer drops."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > _CACHE_WORDS:  # those that are met again stay
            self.known = {w: self.known[w] for w in distinct if w in self.known}
        new = [w for w in distinct if w not in self.known]
        new += [a for i in range(0, len(new), LEARNT) for a in self._learn(new[i : i + LEARNT])]
        found = list(map(self.known.__getitem__, distinct))
        for w in new:
            if len(w) > _CACHE_LENGTH:
                self.known.pop(w, None)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, raw, edge = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4"), words.offsets.to_numpy()
        out, low = [], 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(edge, edge[low] + JOINED, "right")) - 1)
            part = at[edge[low] - edge[0] : edge[high] - edge[0]]
            n = size[part]
            ends = np.append(0, np.cumsum(n))
            ids = raw[np.repeat(first[part] - ends[:-1], n) + np.arange(ends[-1])]
            cut = ends[edge[low : high + 1] - edge[low]]
            ids, cut = np.insert(ids, cut[1:], END_ID), cut + np.arange(len(cut))
            out += [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            low = high
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each process, so that its words stay known from task to task."""
    return Encoder(path)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file that every executor has. A null text is empty: one piece with the end id.
    Each document is cut at multiples of CAPACITY; these pieces are sequences of their own. The rest is cut to at most
    PIECE tokens. Each partition gathers such pieces up to WINDOWS windows less SLACK tokens each, cutting the last one, and
    packs them; what is left when it ends makes one smaller group. Nothing shuffles and no more than a group is held. Sequence ids
    hold the partition's number in the high bits. Repeated rows are packed each for itself; other columns are not read. Ids keep their type; an empty table gives an empty result.
    """

    def run(batches):
        encode, at = encoder(tokenizer), TaskContext.get().partitionId() << 40
        group: list[tuple] = []
        size, most = 0, WINDOWS * (CAPACITY - SLACK)

        def flush():
            nonlocal at, group, size
            rows = []
            for window in pack([len(x[2]) for x in group]):
                offset = 0
                for i in window:
                    doc, start, ids, total = group[i]
                    rows.append((doc, start, len(ids), zlib.crc32(ids), total, at, offset))
                    offset += len(ids)
                at += 1
            group, size = [], 0
            return rows

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for part, _, _ in tb.chunks(batch, "text", TOGETHER):
                rows = []
                docs_ = part.column(part.schema.get_field_index("id")).to_pylist()
                for doc, ids in zip(docs_, encode(part.column(part.schema.get_field_index("text"))), strict=True):
                    whole = len(ids) // CAPACITY * CAPACITY
                    for start in range(0, whole, CAPACITY):
                        rows.append((doc, start, CAPACITY, zlib.crc32(ids[start : start + CAPACITY]), len(ids), at, 0))
                        at += 1
                    start = whole
                    while start < len(ids):
                        n = min(PIECE, len(ids) - start, most - size)
                        group.append((doc, start, ids[start : start + n], len(ids)))
                        start, size = start + n, size + n
                        if size == most:
                            rows += flush()
                yield from _batches(rows, id_type)
        if group:
            yield from _batches(flush(), id_type)
        pa.default_memory_pool().release_unused()  # the process stays for tasks of other kinds

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.map_arrow(rows, run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def _batches(rows, id_type):
    if rows:
        columns = list(zip(*rows, strict=True))
        names = ["id", *(x.split()[0] for x in SCHEMA.split(", "))]
        yield pa.RecordBatch.from_arrays([pa.array(c, id_type if n == "id" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@base.query("op7_packing")
def op7_packing(spark, sf_dir):
    return pack_documents(base.table(spark, sf_dir, "documents"), tokenizer_path())
