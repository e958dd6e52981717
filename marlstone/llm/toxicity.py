"""Toxicity by nearest labelled examples: exact TF-IDF cosine over all terms of the examples."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from . import textbytes as tb

#: Labelled rows that are examples at most, of each label; the first in the order of a hash of the id.
EXAMPLES = 3000
#: Neighbours that vote.
NEIGHBOURS = 15
#: Terms: words, and the first 4, 5 and 6 bytes of longer words.
PREFIXES = (4, 5, 6)
#: A term of more than 1 / FREQUENT of the examples stands in blocks of BLOCK examples, each with its largest weight; blocks that are read before the others' bounds are held against what they hold; term counts that are sent together.
FREQUENT, BLOCK, FIRST, COUNTS = 8, 8, 12, 1 << 15
#: How far a cosine in 32-bit floats may be from the exact one; terms by which examples are put in order.
INEXACT, ORDERED_BY = 1e-4, 256
#: Queries that are answered together, so that a block is read once for all that need it.
TOGETHER = 128
#: Bytes of text whose queries are gathered, so that they fill such groups.
GATHERED = 4 << 20
#: score at which a document is predicted toxic.
THRESHOLD = 0.3


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms and the document of each."""
    words = tb.tokenize(data, offsets, tb.ALNUM, PREFIXES)
    doc, out, of = words.doc, [words.hash], [words.doc]
    for h in words.prefix.values():
        has = h != 0
        out.append(h[has])
        of.append(doc[has])
    return np.concatenate(out), np.concatenate(of)


def _in_parts(rows: list[tuple[str, int]], size: int = 200):
    """(number of the first row, hashes, documents) of the terms of so many rows at a time."""
    for i in range(0, len(rows), size):
        yield i, *_terms(*tb.buffers(pa.array([t for t, _ in rows[i : i + size]], pa.string())))


def _frequencies(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """All terms, and in how many rows each stands; added up part by part."""
    terms, df, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def settle(terms, df):
        every, at = np.unique(np.concatenate([terms, *(t for t, _ in held)]), return_inverse=True)
        out = np.bincount(at, np.concatenate([df, *(c for _, c in held)]), len(every)).astype(np.int64)
        held.clear()
        return every, out

    for _, h, doc in _in_parts(rows):
        each, at = np.unique(h, return_inverse=True)
        held.append((each, np.bincount(np.unique(at.astype(np.int64) * len(rows) + doc) // len(rows), minlength=len(each))))
        if len(held) == 8:
            terms, df = settle(terms, df)
    return settle(terms, df)


class Index:
    """A block-max inverted index of examples, unit TF-IDF vectors over all their terms.

    A frequent term's postings are cut into blocks of BLOCK neighbouring examples, each with the largest weight in it; alike examples stand together.
    A rare term has plain postings, which are no more than its blocks would be.
    """

    def __init__(self, rows: list[tuple[str, int]], total: tuple[int, int] | None = None, documents: Callable | None = None):
        """total: how many labelled rows there are of each label, which the prior follows; documents: from terms to the number of documents and of those with each term, which the idf follows. Else those given."""
        total = total or tuple(np.bincount(np.array([t for _, t in rows], np.int64), minlength=2))
        y = np.array([t for _, t in rows], np.int64)
        n = np.bincount(y, minlength=2)
        self.weight = np.array([total[0] / max(1, n[0]), total[1] / max(1, n[1])])
        self.terms, df = _frequencies(rows)
        every, df = documents(self.terms) if documents else (len(rows), df)
        self.idf = np.log((every + 1) / (df + 1)) + 1
        found = [(np.zeros(0, np.int32),) * 3]
        for first, h, doc in _in_parts(rows):
            found.append(tuple(x.astype(np.int32) for x in self._counts(h, doc + first)))
        doc, at, count = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        some = np.unique(doc)
        cut = np.append(np.searchsorted(doc, some), len(doc))
        order = self._order(at, cut)
        self.labels = y[some][order]
        blank = np.delete(y, some)
        self.prior = float((self.weight[1] * (blank == 1).sum() + 0.5) / (self.weight[blank].sum() + 10))
        size = np.diff(cut)[order]
        where = np.repeat(cut[:-1][order] - np.cumsum(size) + size, size) + np.arange(size.sum())
        at, count = at[where], count[where]
        del doc, where  # large
        self._build(at, count, np.append(0, np.cumsum(size)))
        del at, count
        self.grid = np.linspace(0, 1, 21)
        self.calibrated = self.grid
        self._calibrate()

    def _build(self, at: np.ndarray, count: np.ndarray, cut: np.ndarray):
        """Vectors, postings and matrix of the examples, whose term numbers and counts are at[cut[i] : cut[i + 1]] and so on."""
        self.counts = zlib.compress(np.diff(at, prepend=0).astype(np.int32).tobytes(), 1), zlib.compress(count.astype(np.int32).tobytes(), 1), cut
        n = len(cut) - 1
        doc, w = np.repeat(np.arange(n, dtype=np.int32), np.diff(cut)), (1 + np.log(count)) * self.idf[at]
        w /= np.sqrt(np.bincount(doc, w * w, n))[doc]
        self.own = at.astype(np.int32), w, cut
        size = np.bincount(at, minlength=len(self.terms))
        often = np.flatnonzero(size > max(8, n // FREQUENT))
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[often] = np.arange(len(often))
        dense, blocks = self.row[at] >= 0, -(-n // BLOCK)
        self.blocks = np.zeros((blocks, len(often), BLOCK), np.float32)
        self.blocks[doc[dense] // BLOCK, self.row[at[dense]], doc[dense] % BLOCK] = w[dense]
        self.bounds = np.ascontiguousarray(self.blocks.max(2).T)
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(at[rare], kind="stable")]
        self.postings = np.empty(len(rare), np.uint64)  # a weight and an example's number in 32 bits each
        self.postings.view(np.float32)[::2], self.postings.view(np.int32)[1::2] = w[rare], doc[rare]
        self.first = np.searchsorted(at[rare], np.arange(len(self.terms) + 1))
        self.size, self.places = np.diff(self.first), np.arange(1 << 18)

    def _order(self, at: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Examples by their frequent terms, alike ones next to each other: by the signs of the two main axes, then along the third."""
        n = len(cut) - 1
        size = np.bincount(at, minlength=len(self.terms))
        often = np.argsort(-size, kind="stable")[:ORDERED_BY]
        often = often[size[often] > max(8, n // FREQUENT)]
        if n < 3 or len(often) < 3:
            return np.arange(n)
        row = np.full(len(self.terms), -1, np.int32)
        row[often] = np.arange(len(often))
        has = np.zeros((n, len(often)), np.float32)
        doc, r = np.repeat(np.arange(n), np.diff(cut)), row[at]
        has[doc[r >= 0], r[r >= 0]] = 1
        has -= has.mean(0)
        axes = has @ np.linalg.eigh(has.T @ has)[1][:, -3:]
        return np.lexsort((axes[:, 0], axes[:, 1] > 0, axes[:, 2] > 0))

    def __getstate__(self):
        """What executors can't make anew from the counts."""
        return {k: x for k, x in vars(self).items() if k not in ("own", "postings", "first", "size", "places", "row", "blocks", "bounds")}

    def __setstate__(self, state):
        vars(self).update(state)
        at, count, cut = self.counts
        self._build(np.cumsum(np.frombuffer(zlib.decompress(at), np.int32), dtype=np.int32), np.frombuffer(zlib.decompress(count), np.int32), cut)

    def _counts(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term number, count) of the index's terms, by document and term."""
        return _counts(self.terms, h, doc)

    def vectors(self, data: np.ndarray, offsets: np.ndarray):
        """For each document its (term numbers, weights), of length 1, or none."""
        doc, at, count = self._counts(*_terms(data, offsets))
        w = (1 + np.log(count)) * self.idf[at]
        cut = np.searchsorted(doc, np.arange(len(offsets)))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield at[a:b], w[a:b] / np.sqrt((w[a:b] ** 2).sum()) if b > a else w[a:b]

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of the largest cosine above 0, largest first, ties by number: exact."""
        return self.all_nearest([(at, w)], k, [without])[0]

    def all_nearest(self, queries: list, k: int = NEIGHBOURS, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """nearest() of each of the queries.

        The rare terms' postings and the largest weights of the frequent terms' blocks bound what a block of examples can reach. The blocks of the largest
        bounds are read first; then those whose bound reaches the k-th cosine found so far. The other blocks are not read. All this is in 32-bit floats; what comes
        within their error of the k-th cosine is multiplied out again with the examples' own vectors.
        """
        out = []
        for low in range(0, len(queries), TOGETHER):
            part = queries[low : low + TOGETHER]
            out += self._together(part, k, np.array(without[low : low + TOGETHER]) if without is not None else np.full(len(part), -1))
        return out

    def _together(self, queries: list, k: int, without: np.ndarray) -> list[list[tuple[float, int]]]:
        nq, nb = len(queries), len(self.blocks)
        if not nb:
            return [[] for _ in queries]
        q, scores = np.zeros((nq, self.blocks.shape[1]), np.float32), np.zeros((nq, nb * BLOCK), np.float32)
        for i, (at, w) in enumerate(queries):
            r = self.row[at]
            rare, often = r < 0, r >= 0
            q[i, r[often]] = w[often]
            n = self.size[at[rare]]
            end = np.cumsum(n)
            if len(n) and end[-1]:
                where = np.repeat(self.first[at[rare]] - end + n, n)
                where += self.places[: len(where)] if len(where) <= len(self.places) else np.arange(len(where))
                found = self.postings.take(where, mode="clip")  # "raise" would copy
                scores[i] = np.bincount(found.view(np.int32)[1::2], found.view(np.float32)[::2] * np.repeat(w[rare].astype(np.float32), n), nb * BLOCK)
        cells = scores.reshape(nq, nb, BLOCK)
        bound = cells.max(2) + q @ self.bounds
        wanted, read = np.zeros((nq, nb), bool), np.zeros((nq, nb), bool)
        best = np.argpartition(bound, -min(FIRST, nb), 1)[:, -min(FIRST, nb) :]
        np.put_along_axis(wanted, best, True, 1)
        least = np.zeros(nq, np.float32)
        for again in (False, True):
            for b in np.flatnonzero(wanted.any(0)).tolist():
                rows = np.flatnonzero(wanted[:, b])
                cells[rows, b] += q[rows] @ self.blocks[b]
            read |= wanted
            own = np.flatnonzero(without >= 0)
            scores[own, without[own]] = 0
            known = (np.where(read[:, :, None], cells, 0) if again else np.take_along_axis(cells, best[:, :, None], 1)).reshape(nq, -1)
            if known.shape[1] >= k:
                least = np.partition(known, -k, 1)[:, -k] - 2 * INEXACT
            wanted = (bound >= np.maximum(least, 1e-30)[:, None]) & ~read
        weights = np.zeros(len(self.terms))
        return [self._exact(np.flatnonzero((row > 0) & (row >= edge)), *query, k, weights) for query, row, edge in zip(queries, known, least, strict=True)]

    def _exact(self, found: np.ndarray, at: np.ndarray, w: np.ndarray, k: int, weights: np.ndarray) -> list[tuple[float, int]]:
        """The first k of the found examples by their exact cosine. weights: zeros for all terms, which it leaves as they were."""
        if not len(found):
            return []
        terms, values, cut = self.own
        n = cut[found + 1] - cut[found]
        cuts = list(zip(cut[found].tolist(), cut[found + 1].tolist(), strict=True))
        weights[at] = w
        shared = weights.take(np.concatenate([terms[a:b] for a, b in cuts])) * np.concatenate([values[a:b] for a, b in cuts])
        weights[at] = 0
        scores = np.round(np.add.reduceat(shared, np.cumsum(n) - n), 12)
        order = np.lexsort((found, -scores))[:k]
        return [(s, i) for s, i in zip(scores[order].tolist(), found[order].tolist(), strict=True) if s > 0]

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Share of the toxic votes; a vote weighs the cosine and what its label stands for, beside half a vote of the prior."""
        y = self.labels[[i for _, i in found]]
        s = np.array([x for x, _ in found]) * self.weight[y]
        return float((s[y == 1].sum() + 0.5 * self.prior) / (s.sum() + 0.5))

    def _calibrate(self):
        """Isotonic fit of the examples' labels to the votes that the others cast. An example's vector is then over the terms of the others, as that of any text."""
        terms, values, cut = self.own
        votes, shared = np.zeros(len(self.labels)), np.bincount(terms, minlength=len(self.terms)) > 1
        for low in range(0, len(votes), TOGETHER):
            queries, numbers = [], list(range(low, min(low + TOGETHER, len(votes))))
            for i in numbers:
                at, w = terms[cut[i] : cut[i + 1]], values[cut[i] : cut[i + 1]]
                at, w = at[shared[at]], w[shared[at]]
                queries.append((at, w / np.sqrt((w**2).sum()) if len(at) else w))
            votes[numbers] = [self.vote(found) for found in self.all_nearest(queries, without=numbers)]
        if len(votes):
            order = np.argsort(votes, kind="stable")
            means: list[list[float]] = []
            for v, y in zip(votes[order], self.labels[order], strict=True):
                means.append([v * self.weight[y], float(y) * self.weight[y], self.weight[y]])
                while len(means) > 1 and means[-2][1] / means[-2][2] >= means[-1][1] / means[-1][2]:
                    last = means.pop()
                    means[-1] = [a + b for a, b in zip(means[-1], last, strict=True)]
            self.grid, self.calibrated = np.array([m[0] / m[2] for m in means]), np.array([m[1] / m[2] for m in means])

    def scores(self, queries: list) -> list[tuple[float, list[tuple[float, int]]]]:
        """Calibrated score and the neighbours of each query. No term: the prior of examples without terms."""
        return [(float(np.interp(self.vote(found), self.grid, self.calibrated)) if found else self.prior, found) for found in self.all_nearest(queries)]


def _counts(terms: np.ndarray, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number of the term in the sorted terms, count), by document and term; hashes of no term are left out."""
    order = np.argsort(h)  # neighbours are found in the same part of the terms
    h, doc = h[order], doc[order]
    at = np.searchsorted(terms, h)
    at[at == len(terms)] = 0
    ok = terms[at] == h if len(terms) else np.zeros(len(h), bool)
    pair, count = np.unique(doc[ok].astype(np.int64) * max(1, len(terms)) + at[ok], return_counts=True)
    return pair // max(1, len(terms)), pair % max(1, len(terms)), count


def spread(docs: DataFrame, text_col: str, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each of the sorted terms: one narrow pass and a shuffle of blocks of counts, both bounded by the terms in each task."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def blocks(n, df):
        yield -1, np.array([n], np.int64)
        for i in range(0, len(df), COUNTS):
            yield i, df[i : i + COUNTS]

    def rows(found):
        for i, x in found:
            if x.any():
                yield pa.RecordBatch.from_pydict({"first": pa.array([i], pa.int64()), "counts": pa.array([zlib.compress(np.ascontiguousarray(x).tobytes(), 1)], pa.binary())})

    def read(batches):
        terms, n = sent.value, 0
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for part, data, offsets in tb.chunks(batch, "text"):
                n += part.num_rows
                df += np.bincount(_counts(terms, *_terms(data, offsets))[1], minlength=len(terms))
        yield from rows(blocks(n, df))

    def add(batches):
        total: dict = {}
        for batch in batches:
            for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(x), np.int64)
        yield from rows(total.items())

    schema = "first long, counts binary"
    parts = base.map_arrow(docs.select(F.col(text_col).alias("text")), read, schema).repartition("first")
    n, df = 0, np.zeros(len(terms), np.int64)
    for r in base.map_arrow(parts, add, schema).collect():  # at most the terms, whatever the input
        x = np.frombuffer(zlib.decompress(r.counts), np.int64)
        if r.first < 0:
            n = int(x[0])
        else:
            df[r.first : r.first + len(x)] = x
    return n, df


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", most: int = EXAMPLES) -> Index:
    """An index of at most `most` labelled rows of each label that aren't held out; of more, the first in the order of a hash of the id. No example is left out for being like another.

    Repeated or null labels: the largest counts, null is none. Repeated ids: the text of the smallest hash counts. Null texts are no examples, empty ones make the prior. Without labels every score is the same.
    """
    known = labels.filter(~base.held_out(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    known = base.stash(texts.groupBy("id").agg(F.min(F.xxhash64("t")).alias("h")).join(known, "id"))
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = base.stash(base.first_of_each(known, "y", "id", most))
    rows = texts.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), ["id", "h"]).groupBy("id", "y").agg(F.min("t").alias("t")).orderBy("id").collect()
    return Index([(r.t or "", int(r.y)) for r in rows], (total.get(0, 0), total.get(1, 0)), lambda terms: spread(docs, text_col, terms))


def rate(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with three further columns, whose names are returned: score, predicted, evidence.

    evidence: the neighbours as array<struct<example int, toxic int, cosine double>>, nearest first. Texts that hold no
    term, null and empty ones too, have the rate of such examples as score and no evidence. A narrow pass: no shuffle;
    the index is of a bounded size. An empty table gives an empty result; if docs has columns of these names, the new ones get an underscore in front. Documents with the same terms in the same numbers are looked up once in a part of a batch.
    """
    names = base.fresh(docs, "score", "predicted", "evidence")
    kinds = ("double", "int", "array<struct<example:int,toxic:int,cosine:double>>")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, kinds, strict=True))])
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = sent.value
        for batch in batches:
            for part, _, _ in tb.chunks(batch, text_col, GATHERED):
                queries = [x for _, data, offsets in tb.chunks(part, text_col) for x in index.vectors(data, offsets)]
                keys = [(at.tobytes(), w.tobytes()) for at, w in queries]
                first = {key: i for i, key in reversed(list(enumerate(keys)))}
                known = dict(zip(first, index.scores([queries[i] for i in first.values()]), strict=True))
                score = [known[key][0] for key in keys]
                why = [[{"example": i, "toxic": int(index.labels[i]), "cosine": c} for c, i in known[key][1]] for key in keys]
                new = [pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array(why, pa.list_(pa.struct([("example", pa.int32()), ("toxic", pa.int32()), ("cosine", pa.float64())])))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return base.map_arrow(docs, run, schema), names


@base.query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs, labels = base.table(spark, sf_dir, "documents").select("doc_id", "text"), base.table(spark, sf_dir, "labels")
    found, _ = rate(docs, fit(docs, labels))
    return found.select("doc_id", base.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("evidence").alias("n_neighbours"))
