"""Substring deduplication by fixed-block anchors, extended to maximal exact repeats."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from . import textbytes as tb

#: Words of a repeat, at least; blocks are of such a size that every window of WINDOW words holds a whole one.
WINDOW = 35
BLOCK = (WINDOW + 1) // 2
#: Bytes of text in which repeats are found before any shuffle.
TOGETHER = 2 << 20
#: Bytes of input (as Catalyst estimates them) for each partition of the hash shuffles.
BYTES_A_PARTITION = 16 << 20

_ROWS = "bucket int, found boolean, payload binary"
_FOUND = "bucket int, payload binary"
_RUNS = "rid long, runs binary"


def _planes(x: np.ndarray) -> bytes:
    """uint32 as four byte planes; those of zeros compress to nothing."""
    return np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _payload(keys: tuple[np.ndarray, np.ndarray], at: np.ndarray, first: np.ndarray, rids: np.ndarray) -> bytes:
    """Keys (40 bits, or 64 and 16), the word numbers they stand at, and where the documents among them begin."""
    low, high = keys
    doc = np.searchsorted(first, at, "right") - 1
    used = np.unique(doc)
    k = low.view(np.uint8).reshape(-1, 8)[:, :5].tobytes() if high is None else low.tobytes() + high.tobytes()
    step = np.diff(at, prepend=0)
    return struct.pack("<II", len(at), len(used)) + rids[used].tobytes() + _planes(first[used]) + _planes(step) + k


class _Entries:
    """Payloads of one bucket, read back."""

    def __init__(self, wide: bool):
        self.wide, self.parts = wide, []

    def add(self, payload: bytes):
        n, d = struct.unpack_from("<II", payload)
        view, at = memoryview(payload), 8
        cut = []
        for size in (8 * d, 4 * d, 4 * n):
            cut.append(view[at : at + size])
            at += size
        if self.wide:
            low, high = np.frombuffer(view, np.uint64, n, at), np.frombuffer(view, np.uint16, n, at + 8 * n)
        else:
            raw = np.zeros((n, 8), np.uint8)
            raw[:, :5] = np.frombuffer(view, np.uint8, 5 * n, at).reshape(-1, 5)
            low, high = raw.view(np.uint64).ravel(), None
        self.parts.append((low, high, np.frombuffer(cut[0], np.int64), _unplanes(cut[1]), np.cumsum(_unplanes(cut[2]), dtype=np.int64)))

    def hits(self):
        """(rid, positions) of the entries that stand somewhere else too: as a block, or for wide keys at all."""
        low = np.concatenate([p[0] for p in self.parts])
        if self.wide:
            high = np.concatenate([p[1] for p in self.parts])
            order = np.lexsort((high, low))
            new = np.concatenate(([True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])))
            others = np.diff(np.append(np.flatnonzero(new), len(low)))[np.cumsum(new) - 1] - 1
        else:
            block = (low & np.uint64(1)).astype(np.int64)
            key = low >> np.uint64(1)
            order = np.argsort(key)
            new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            others = np.add.reduceat(block[order], np.flatnonzero(new))[np.cumsum(new) - 1] - block[order]
        hit = np.zeros(len(low), bool)
        hit[order[others > 0]] = True
        begin = 0
        for part in self.parts:
            own = np.flatnonzero(hit[begin : begin + len(part[0])])
            begin += len(part[0])
            if len(own):
                at = part[4][own]
                doc = np.searchsorted(part[3], at, "right") - 1
                yield part[2][doc], at - part[3][doc]


class _Found:
    """Found positions of rows, packed by group of rows; given out when there are many."""

    def __init__(self, groups: int):
        self.groups, self.held, self.n = groups, [], 0

    def add(self, rids: np.ndarray, positions: np.ndarray):
        self.held.append((rids, positions.astype(np.uint32)))
        self.n += len(rids)
        return self.flush() if self.n > 2_000_000 else []

    def flush(self):
        if not self.n:
            return []
        rids, positions = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        group = _group(rids, self.groups)
        order = np.lexsort((positions, rids, group))
        rids, positions, group = rids[order], positions[order], group[order]
        rows = []
        for a, b in _cuts(group):
            r, p = rids[a:b], positions[a:b]
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            step = np.diff(p, prepend=np.uint32(0))
            step[first] = p[first]
            rows.append((int(group[a]), struct.pack("<I", len(first)) + r[first].tobytes() + _planes(np.diff(np.append(first, len(r)))) + _planes(step)))
        return rows


def _group(rids: np.ndarray, groups: int) -> np.ndarray:
    return (tb.mix(rids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _cuts(x: np.ndarray):
    """(start, end) of the runs of equal values."""
    cut = np.append(np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))), len(x)) if len(x) else np.zeros(1, int)
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", payload)
    view = memoryview(payload)
    rids, counts = np.frombuffer(view, np.int64, n, 4), _unplanes(view[4 + 8 * n : 4 + 12 * n])
    step = _unplanes(view[4 + 12 * n :]).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(counts) - counts
    return np.repeat(rids, counts), total - np.repeat(total[first] - step[first], counts)


def _deal(low, high, at, known, words, rids, buckets, wide):
    """Rows for a chunk: what is known to repeat within the chunk goes as found positions, the rest as payloads by bucket."""
    first = words.first[:-1]
    at_known = at[known[0]]
    if len(at_known):
        doc = np.searchsorted(words.first, at_known, "right") - 1
        found = _Found(buckets)
        for group, payload in [*found.add(rids[doc], at_known - first[doc]), *found.flush()]:
            yield group, True, payload
    sent = known[1]
    bucket = ((low[sent] & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    filled = np.flatnonzero(np.diff(words.first))
    for b in np.flatnonzero(np.diff(cut)):
        i = sent[order[cut[b] : cut[b + 1]]]
        keys = (low[i], high[i]) if wide else ((low[i] >> np.uint64(25) << np.uint64(1)) | high[i], None)
        yield int(b), False, _payload(keys, at[i], first[filled], rids[filled])


def _anchors(words: tb.Words, rids, buckets):
    """Every BLOCK consecutive words of documents of WINDOW words or more; those at multiples of BLOCK are the indexed blocks."""
    low = tb.rolling(words.hash, BLOCK)
    long = np.repeat(words.counts >= WINDOW, words.counts)[: len(low)]
    at = np.flatnonzero(tb.window_starts(words.first, BLOCK) & long)
    if not len(at):
        return
    low = low[at]
    block = ((at - np.repeat(words.first[:-1], words.counts)[at]) % BLOCK == 0).astype(np.uint64)
    order = np.argsort(low, kind="stable")
    new = np.concatenate(([True], low[order][1:] != low[order][:-1]))
    group = np.empty(len(low), np.int64)
    group[order] = np.cumsum(new) - 1
    blocks = np.bincount(group, block)
    known = blocks[group] - block > 0
    # of the keys whose entries are all known one block is still sent, for the other chunks
    mine = np.flatnonzero(known & (block == 1))
    one = mine[np.unique(group[mine], return_index=True)[1]]
    sent = np.sort(np.concatenate((np.flatnonzero(~known), one)))
    yield from _deal(low, block, at, (known, sent), words, rids, buckets, False)


def _windows(words: tb.Words, rids, buckets, hits):
    """Every window of WINDOW words that holds a hit."""
    low = tb.rolling(words.hash, WINDOW)
    cover = np.zeros(len(words.hash) + 1, np.int64)
    for d, runs in enumerate(hits):
        # a run of hit blocks lies in the windows that begin up to WINDOW - BLOCK words before it
        r = np.frombuffer(runs, np.int32).reshape(-1, 2).astype(np.int64) + words.first[d]
        last = max(int(words.first[d + 1]) - WINDOW, int(words.first[d]) - 1)
        np.add.at(cover, np.minimum(np.maximum(r[:, 0] - (WINDOW - BLOCK), words.first[d]), last + 1), 1)
        np.add.at(cover, np.minimum(r[:, 1] - BLOCK, last) + 1, -1)
    at = np.flatnonzero(np.cumsum(cover)[: len(low)] > 0)
    if not len(at):
        return
    low, high = low[at], (tb.rolling(words.hash, WINDOW, 1)[at] & np.uint64(0xFFFF)).astype(np.uint16)
    order = np.lexsort((high, low))
    new = np.concatenate(([True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])))
    size = np.diff(np.append(np.flatnonzero(new), len(low)))[np.cumsum(new) - 1]
    known = np.zeros(len(low), bool)
    known[order[size > 1]] = True
    sent = np.sort(np.concatenate((np.flatnonzero(~known), order[new & (size > 1)])))
    yield from _deal(low, high, at, (known, sent), words, rids, buckets, True)


def _runs(p: np.ndarray, length: int) -> np.ndarray:
    """Disjoint (start, end) ranges that `length` words from each of the sorted positions cover; ranges that touch are one."""
    new = np.flatnonzero(np.concatenate(([True], np.diff(p) > length)))
    return np.stack((p[new], p[np.append(new[1:], len(p)) - 1] + length), 1).astype(np.int32)


def _rows(rows, schema_names, types):
    rows = list(rows)
    if rows:
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema_names)]
    return []


def _shuffle(rows: DataFrame, make, buckets: int, wide: bool) -> DataFrame:
    """rows through make() into payloads by bucket, what each bucket finds by group of rows, and (rid, runs) of what is found."""
    length = WINDOW if wide else BLOCK

    def read(batches):
        for batch in batches:
            for part, data, offsets in tb.chunks(batch, "text", TOGETHER, 1 << 16):
                rids = part.column(part.schema.get_field_index("rid")).to_numpy()
                hits = part.column(part.schema.get_field_index("runs")).to_pylist() if wide else None
                words = tb.tokenize(data, offsets, tb.SPACED)
                yield from _rows(make(words, rids, buckets, *([hits] if wide else [])), ["bucket", "found", "payload"], [pa.int32(), pa.bool_(), pa.binary()])

    def find(batches):
        held: dict[int, _Entries] = {}
        out, names, kinds = _Found(buckets), ["bucket", "payload"], [pa.int32(), pa.binary()]
        for batch in batches:
            for b, known, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known:
                    yield from _rows(out.add(*_unpack(payload)), names, kinds)
                else:
                    held.setdefault(b, _Entries(wide)).add(payload)
        for b in list(held):
            for rids, positions in held.pop(b).hits():
                yield from _rows(out.add(rids, positions), names, kinds)
        yield from _rows(out.flush(), names, kinds)

    def gather(batches):
        parts = [_unpack(p) for batch in batches for p in batch.column(1).to_pylist()]
        if parts:
            rids, positions = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((positions, rids))
            rids, positions = rids[order], positions[order]
            cuts = _cuts(rids)
            for k in range(0, len(cuts), 4096):
                yield from _rows([(int(rids[a]), _runs(positions[a:b], length).tobytes()) for a, b in cuts[k : k + 4096]], ["rid", "runs"], [pa.int64(), pa.binary()])

    dealt = base.map_arrow(rows, read, _ROWS).repartitionById(buckets, F.col("bucket"))
    return base.map_arrow(base.map_arrow(dealt, find, _FOUND).repartitionById(buckets, F.col("bucket")), gather, _RUNS)


def _held(runs: DataFrame) -> int:
    """Bytes of runs."""
    return runs.agg(F.coalesce(F.sum(F.octet_length("runs") + 32), F.lit(0)).alias("n")).first().n


def repeats(docs: DataFrame, text_col: str, rid) -> DataFrame:
    """(rid, runs): for each row with repeats the covered words, as int32 pairs (start, end)."""
    rows = docs.select(rid.alias("rid"), F.col(text_col).alias("text"))
    buckets = base.partitions(docs, BYTES_A_PARTITION)
    hits = base.stash(_shuffle(rows, _anchors, buckets, False))
    return base.stash(_shuffle(base.semi_first(rows, hits, "rid", size=_held(hits)), _windows, buckets, True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, and with keep_text the kept words joined by one space.

    Words are [^ \\t-\\r]+. Each word goes that lies in a window of WINDOW words whose words, in order, also start anywhere else in
    any row, the same one included. Non-overlapping blocks of BLOCK words are the index; every BLOCK consecutive words probe it.
    Of two equal windows, each holds a block of its own that the other's probe meets, so both hold a hit; the windows around hits
    are then compared whole, by 80 bits of two hashes besides the bucket, and what they cover are the maximal repeats. Both shuffles
    carry hashes only, in as many buckets as the input asks for; a key that repeats within a chunk of text is settled there and sent once.
    Null and empty texts have no words; an empty table gives an empty result. Rows that are repeated count as often as they are there. Positions find their row again by a 64-bit
    hash of id and text. Positions and runs are broadcast if they fit base.BROADCAST_BYTES; beyond, a Bloom filter of their rows goes first, so that of the texts only those with hits shuffle.
    """
    rid = base.row_key(F.col(id_col), F.col(text_col))
    runs = repeats(docs, text_col, rid)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rid.alias("rid"))
    rows = base.semi_first(rows, runs, "rid", how="left", size=_held(runs)).select("id", "text", "runs")

    def cut(batches):
        for batch in batches:
            for part, data, offsets in tb.chunks(batch, "text"):
                whole, n_words, n_removed, kept_all = data.tobytes(), [], [], []
                for a, b, r in zip(offsets[:-1], offsets[1:], part.column(2).to_pylist(), strict=True):
                    words = whole[a:b].split()
                    n_words.append(len(words))
                    kept, at = words, 0
                    if r:
                        kept = []
                        for s, e in np.frombuffer(r, np.int32).reshape(-1, 2).tolist():
                            kept += words[at:s]
                            at = e
                        kept += words[at:]
                    n_removed.append(len(words) - len(kept))
                    kept_all.append(b" ".join(kept))
                out = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept_all])]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(kept_all, pa.binary()).cast(pa.string())] if keep_text else [])], names=names)

    names = ["id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])]
    kinds = [rows.schema["id"].dataType.simpleString(), "long", "long", "string", "string"]
    return base.map_arrow(rows, cut, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=False))).withColumnRenamed("id", id_col)


_ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
w as (select doc_id, unnest(generate_series(1, len(ws) - 34)) i, ws from d where len(ws) >= 35),
g as (select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) g from w),
r as (select doc_id, i from (select *, count(*) over (partition by g) n from g) where n > 1),
gone as (select distinct doc_id, unnest(generate_series(i, i + 34)) p from r),
k as (select doc_id, p, ws[p] word from (select doc_id, ws, unnest(generate_series(1, len(ws))) p from d) anti join gone using (doc_id, p)),
kept as (select doc_id, count(*) n, string_agg(word, ' ' order by p) t from k group by 1)
select d.doc_id, len(ws) n_words, len(ws) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)
"""


@base.query("op9_substring_dedup", _ORACLE)
def op9_substring_dedup(spark, sf_dir):
    return remove_repeats(base.table(spark, sf_dir, "documents"))
