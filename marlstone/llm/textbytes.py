"""Words and their rolling hashes over Arrow text, vectorised on UTF-8 bytes.

A word class that is defined on ASCII characters and takes in every other character can be read
byte by byte: in UTF-8 all bytes of other characters are 0x80 or more. All hashes are fixed functions of
the bytes: the same in every task, process and run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to so many bytes and rows; a longer text comes alone.
CHUNK_BYTES, CHUNK_ROWS = 256 << 10, 1024
_PIECE = 1 << 20
#: Words of more bytes are hashed by BLAKE2b: a polynomial modulo 2^64 gives some pairs of long words (from 1,024 bytes) the same value.
LONG_WORD = 64

_MULTIPLIERS = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n."""
    if which not in _powers or len(_powers[which][0]) < n:
        size, r = max(n, _PIECE + 1), _MULTIPLIERS[which]
        both = []
        for x in (r, pow(r, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[which] = tuple(both)
    a, b = _powers[which]
    return a[:n], b[:n]


@dataclass(frozen=True)
class WordClass:
    """Which bytes belong to words, and what each counts as."""

    member: np.ndarray
    fold: np.ndarray


def _class(member, fold_case: bool) -> WordClass:
    fold = np.arange(256, dtype=np.uint8)
    if fold_case:
        fold[65:91] += 32
    return WordClass(np.array([member(b) for b in range(256)]), fold)


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = _class(lambda b: b >= 0x80 or chr(b).isalnum(), True)
#: [^\x20\x09-\x0D]+, unchanged.
SPACED = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D, False)


@dataclass
class Words:
    """The words of some documents in order; those of document i are first[i]:first[i + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of at most so many bytes of text and rows, or one row, with their bytes and offsets."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(sizes, base + most, "right"))))
        part = batch.slice(at, to - at)
        yield part, *buffers(texts.slice(at, to - at))
        at = to


def tokenize(data: np.ndarray, offsets: np.ndarray, kind: WordClass, prefixes: tuple[int, ...] = ()) -> Words:
    """The words of all texts. prefixes: also hashes of the first so many bytes of longer words, in .prefix."""
    n = len(data)
    inside = kind.member[data]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins, ends = inside.copy(), inside.copy()
    if n:
        before, after = inside[:-1].copy(), inside[1:].copy()
        before[edge - 1] = False
        after[edge - 1] = False
        begins[1:] &= ~before
        ends[:-1] &= ~after
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = np.empty(len(start), np.uint64)
    more = {p: np.zeros(len(start), np.uint64) for p in prefixes}
    table = _BYTES[kind.fold]
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _PIECE, "right")))
        low, s, e = start[at], start[at:to] - start[at], end[at:to] - start[at]
        up, down = powers(int(e[-1]) + 1)
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(table[data[low : low + e[-1]]] * up[: e[-1]], out=sums[1:])
        h[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        for p, out in more.items():
            long = np.flatnonzero(e - s > p)
            out[at + long] = mix((sums[s[long] + p] - sums[s[long]]) * down[s[long]] + np.uint64(p << 40))
        at = to
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(kind.fold[data[start[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    words = Words(h, start, end, np.searchsorted(start, offsets))
    words.prefix = more
    return words


def rolling(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each n consecutive elements, from len(h) - n + 1 starts; documents are not told apart."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1, which)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1] + np.uint64(n))


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Which of the starts of rolling(_, n) lie in one document with all n elements."""
    total = int(first[-1])
    ok = np.zeros(max(total, 0) + 1, np.int32)
    size = np.diff(first)
    has = size >= n
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, (first[1:] - n + 1)[has], -1)
    return np.cumsum(ok)[: max(0, total - n + 1)] > 0
