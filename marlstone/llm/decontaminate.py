"""Benchmark decontamination: winnowed fingerprints of documents and items are joined, and hits are extended to exact windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from . import textbytes as tb

#: Words in a window; a fingerprint covers K of them, and the smallest of each window counts: a shared span of WINDOW words always shares one.
WINDOW, K = 13, 5
#: Bits of the Bloom filter for each fingerprint of the items, and at most (32 MB); with more fingerprints it lets more through to the join, which changes no result.
FILTER_BITS, FILTER_MOST = 64, 1 << 28
_WINDOWS = "print long, n int, a long, b long"


def winnow(h: np.ndarray) -> np.ndarray:
    """The smallest K-gram hash of each window of WINDOW words."""
    grams, span = tb.rolling(h, K), WINDOW - K + 1
    have, low = 1, grams
    while have < span:
        step = min(have, span - have)
        low, have = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0], have + step
    return low


def _windows(words: tb.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of every window of n words: the winnowed one of whole windows, the hash of all words of shorter ones."""
    low = winnow(words.hash) if n == WINDOW else tb.rolling(words.hash, n)
    at = np.flatnonzero(tb.window_starts(words.first, n))
    return at, low[at]


def _keys(words: tb.Words, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the windows of n words that start there."""
    return tuple(tb.rolling(words.hash, n, k)[at].view(np.int64) for k in (0, 1))


def _of_items(batches):
    """The windows of items (item, text)."""
    for batch in batches:
        for part, data, offsets in tb.chunks(batch, "text"):
            words = tb.tokenize(data, offsets, tb.ALNUM)
            for n in np.unique(np.minimum(words.counts, WINDOW)).tolist():
                at, prints = _windows(words, n) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                whole = np.minimum(words.counts, WINDOW)[words.doc[at]] == n
                at, prints = at[whole], prints[whole]
                a, b = _keys(words, n, at) if n else (at, at)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(a), pa.array(b), part.column(0).take(pa.array(words.doc[at]))], names=["print", "n", "a", "b", "item"])


class Filter:
    """A Bloom filter of two places for each fingerprint."""

    def __init__(self, prints: DataFrame):
        """prints: a stashed column of distinct fingerprints. The driver holds the filter, never the fingerprints."""
        self.bits = min(FILTER_MOST, 1 << max(16, (prints.count() * FILTER_BITS - 1).bit_length()))
        place = lambda h: (h.bitwiseAND(self.bits - 1) + 1).alias("p")
        places = prints.select(place(F.col("print"))).unionAll(prints.select(place(F.shiftrightunsigned("print", 32))))
        self.bytes = np.zeros(self.bits // 8, np.uint8)
        for r in base.bitmaps(places).collect():
            self.bytes[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bitmap, np.uint8)

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        """Which of these may be among the fingerprints."""
        out = np.ones(len(prints), bool)
        for p in (prints, prints >> np.uint64(32)):
            p = (p & np.uint64(self.bits - 1)).astype(np.int64)
            out &= (self.bytes[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def _of_documents(filter_, lengths: list[int]):
    """A function that finds the windows of documents (key, text) that the filter lets through; at: the start and the length in the last four bits."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in tb.chunks(batch, "text"):
                words = tb.tokenize(data, offsets, tb.ALNUM)
                for n in lengths:
                    at, prints = _windows(words, n)
                    some = filter_.value(prints)
                    at, prints = at[some], prints[some]
                    if len(at):
                        a, b = _keys(words, n, at)
                        doc = words.doc[at]
                        where = (at - words.first[doc]) * 16 + n
                        yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array(a), pa.array(b), part.column(0).take(pa.array(doc)), pa.array(where.astype(np.int64))], names=["print", "n", "a", "b", "key", "at"])

    return run


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str, item_text: str, text_col: str) -> DataFrame:
    """(key, at array<long>, items array<string>) of the documents that hold a window of an item; key: the digest of the text."""
    spark = docs.sparkSession
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    windows = base.stash(base.map_arrow(items, _of_items, f"{_WINDOWS}, item string").distinct())
    prints = base.stash(windows.select("print").distinct())
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # WINDOW of them at most
    sent = spark.sparkContext.broadcast(Filter(prints))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.unhex(F.md5(F.col(text_col))).alias("key"), F.col(text_col).alias("text"))
    found = base.map_arrow(texts, _of_documents(sent, lengths), f"{_WINDOWS}, key binary, at long")
    found = base.stash(found.groupBy("key", "at").agg(*(F.first(c).alias(c) for c in ("print", "n", "a", "b"))))  # copies of a text are one
    join = ["print", "n", "a", "b"]
    one = base.stash(found.join(base.bounded(base.stash(windows.select(*join).distinct()), 64), join))
    at = one.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("at"))
    of = one.join(base.bounded(windows, 128), join).select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return base.stash(at.join(of, "key"))


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", item_text: str = "text", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with four further columns, whose names are returned: n_words, n_hit, items array<string>, spans array<int>.

    A window is WINDOW consecutive words of an item, or a whole shorter item; words inside any occurrence
    of one are hit. spans holds the merged hit ranges as start, end, start, end. Null or wordless texts have no words; items
    without words and null items have no windows; items of null id go by ''; items with the same id are one. Repeated rows are marked alike.

    1. Both sides give the winnowed fingerprint of each window; documents give those that a Bloom filter of the items' fingerprints, of a bounded size, lets through.
    2. They are joined on the fingerprint and, which extends a hit to the whole window, on 128 bits of its words; windows of equal texts are joined once.
    3. What is found is grouped by document and joined to the rows; documents without hits don't shuffle. A document's hits are held together, and they are at most its words.
    """
    names = base.fresh(docs, "n_words", "n_hit", "items", "spans")
    key, at, items = base.fresh(docs, "hit_key", "hit_at", "hit_items")
    found = hits(docs, benchmark, id_col, item_text, text_col).toDF(key, at, items)
    held = found.agg(F.sum(F.size(at) * 8 + 96 + F.octet_length(F.array_join(items, ",")))).first()[0] or 0
    rows = base.semi_first(docs.withColumn(key, F.unhex(F.md5(F.col(text_col)))), found, key, how="left", size=held)
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns), at, F.coalesce(items, F.array().cast("array<string>")).alias(names[2]))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, ("long", "long", "array<string>", "array<int>"), strict=True))])
    own = len(docs.columns)

    def run(batches):
        for batch in batches:
            for part, data, offsets in tb.chunks(batch, text_col):
                words = tb.tokenize(data, offsets, tb.ALNUM)
                spans = [_merged([(x >> 4, (x >> 4) + (x & 15)) for x in hit]) if hit else [] for hit in part.column(part.schema.get_field_index(at)).to_pylist()]
                n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
                new = [pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), part.column(part.schema.get_field_index(names[2])), pa.array(spans, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:own], *new], names=schema.names)

    return base.map_arrow(rows, run, schema), names


def _merged(spans) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def is_contaminated(n_words, n_hit):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """docs without those of which a twentieth of the words or more is hit; all columns stay. Null texts and texts without words have no hit and stay; with an empty benchmark all do."""
    marked, (n_words, n_hit, *_) = mark(docs, benchmark, **columns)
    return marked.filter(~is_contaminated(n_words, n_hit)).select(*[F.col(f"`{c}`") for c in docs.columns])


_ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{base.UPPER}', '{base.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), '{base.UPPER}', '{base.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
bw as (select item, least(13, len(ws)) n, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) i, ws from b where len(ws) > 0),
bg as (select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') g from bw),
dw as (select doc_id, n, unnest(generate_series(1, len(ws) - n + 1)) i, ws from d, (select distinct n from bg) where len(ws) >= n),
h as (select doc_id, i, n, item from (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') g from dw) join bg using (n, g)),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) p from h) group by 1),
it as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item from h) group by 1)
select d.doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""


@base.query("op2_decontaminate", _ORACLE)
def op2_decontaminate(spark, sf_dir):
    marked, (n_words, n_hit, items, _) = mark(base.table(spark, sf_dir, "documents").select("doc_id", "text"), base.table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort(items), ","), 256)
    return marked.select("doc_id", n_words, n_hit, F.size(items).cast("long").alias("n_items"), digest.alias("items_sha256"), is_contaminated(n_words, n_hit).alias("contaminated"))
