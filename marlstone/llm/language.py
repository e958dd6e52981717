"""Language identification by error-correcting output codes over binary byte-n-gram classifiers."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from . import textbytes as tb

#: Labelled rows that the classifiers are fitted on: the first so many of each language, in the order of a hash of the id.
ROWS_A_LANGUAGE = 400
#: n-grams of 2 and 3 bytes share so many slots; it is also the size of what is broadcast, times the bits.
SLOTS = 1 << 16
#: Bytes whose n-grams are held at once, within long texts too.
PIECE_BYTES = 128 << 10
#: Two best codewords whose losses differ by less are ambiguous.
AMBIGUOUS = 0.1
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1. Up to 7 languages: all 2^(n-1)-1 splits; more: of random codes the one of the widest least distance."""
    if n <= 7:
        bits = [[1 if i == 0 or k >> (i - 1) & 1 else -1 for i in range(n)] for k in range(2 ** (n - 1) - 1)] or [[1] * n]
        return np.array(bits, np.int8).T
    length = 10 * int(np.ceil(np.log2(n)))
    codes = (np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (n, length)) for seed in range(200))
    return max(codes, key=lambda c: min(int((a != b).sum()) for a, b in combinations(c, 2)))


def ngrams(data: np.ndarray, offsets: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all 2- and 3-grams that hold a letter and start at bytes low to high, and the document of each. Other bytes count as spaces."""
    high = len(data) if high is None else min(high, len(data))
    x = _FOLD[data[low : high + 2]].astype(np.uint32)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.clip(offsets, low, low + len(x))))
    slots, docs = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
    for n in (2, 3):
        m = min(high - low, len(x) - n + 1)
        if m > 0:
            code = x[:m]
            for k in range(1, n):
                code = code * np.uint32(256) + x[k : m + k]
            ok = (doc[:m] == doc[n - 1 : m + n - 1]) & (code != sum(32 << 8 * k for k in range(n)))
            slots.append(((code[ok] + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(16))
            docs.append(doc[:m][ok])
    return np.concatenate(slots), np.concatenate(docs)


class Model:
    """Bit classifiers: log-odds weights of the slots, a scale and an offset that turn the mean weight into a margin, and their reliability."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for _, lang in rows})
        self.codes = codewords(len(self.languages)) if rows else np.zeros((0, 0), np.int8)
        y = np.array([self.languages.index(lang) for _, lang in rows], np.int64)
        data, offsets = tb.buffers(pa.array([t for t, _ in rows], pa.string()))
        counts = np.zeros((len(self.languages), SLOTS))
        for i in range(0, len(rows), 256):
            a, b = offsets[i], offsets[min(i + 256, len(rows))]
            slots, docs = ngrams(data[a:b], offsets[i : i + 257] - a)
            counts += np.bincount(y[docs + i] * SLOTS + slots, minlength=counts.size).reshape(counts.shape)
        self.weights = np.zeros((SLOTS, self.codes.shape[1]), np.float32)
        for b, code in enumerate(self.codes.T):
            odds = []
            for side in (1, -1):
                n = (counts[code == side] / np.maximum(1, counts[code == side].sum(1, keepdims=True))).sum(0)
                n = n / max(1, (code == side).sum()) * 1e6
                odds.append(np.log((n + 0.5) / (n.sum() + 0.5 * SLOTS)))
            self.weights[:, b] = odds[0] - odds[1]
        z = np.concatenate([self.means(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])) for i in range(len(rows))]) if rows else np.zeros((0, self.codes.shape[1]))
        self.scale, self.offset, self.reliable = np.ones(self.codes.shape[1]), np.zeros(self.codes.shape[1]), np.ones(self.codes.shape[1])
        for b, code in enumerate(self.codes.T):
            want = code[y]
            self.scale[b], self.offset[b] = _logistic(z[:, b], want)
            wrong = (np.sum(np.sign(z[:, b] * self.scale[b] + self.offset[b]) != want) + 0.5) / (len(rows) + 1)
            self.reliable[b] = max(0.05, np.log((1 - wrong) / wrong))

    def means(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean weight of each document's n-grams, for each bit; 0 where there are none."""
        n, total = np.zeros(len(offsets) - 1), np.zeros((len(offsets) - 1, self.codes.shape[1]))
        for low in range(0, len(data), PIECE_BYTES):
            slots, docs = ngrams(data, offsets, low, low + PIECE_BYTES)
            n += np.bincount(docs, minlength=len(n))
            for b, w in enumerate(self.weights.T):
                total[:, b] += np.bincount(docs, w[slots], len(n))
        return total / np.maximum(n, 1)[:, None]

    def decode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document: number of the nearest codeword, score, ambiguous. The loss of a codeword is the bits' logistic loss, weighted by reliability."""
        margin = self.means(data, offsets) * self.scale + self.offset
        loss = np.logaddexp(0, -margin[:, None, :] * self.codes[None]) @ (self.reliable / self.reliable.sum())
        order = np.sort(loss, 1)
        score = 1 / np.exp((order[:, :1] - loss) * self.codes.shape[1]).sum(1)
        return loss.argmin(1), score, (order[:, 1] - order[:, 0] < AMBIGUOUS) if loss.shape[1] > 1 else np.zeros(len(loss), bool)


def _logistic(z: np.ndarray, want: np.ndarray) -> tuple[float, float]:
    """Newton steps of a slightly damped logistic regression on one feature."""
    x, t, w = np.stack([z, np.ones_like(z)], 1), (want > 0).astype(float), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-3]), x.T @ (p - t) + 1e-3 * w)
    return float(max(w[0], 1e-3)), float(w[1])


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have a letter of any script."""
    ascii_ = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
    more = np.concatenate(([0], np.cumsum(data >= 128)))
    out = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~out & (more[offsets[1:]] > more[offsets[:-1]])):
        out[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
    return out


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", rows: int = ROWS_A_LANGUAGE) -> Model:
    """A model of at most `rows` labelled rows of each language that aren't held out; of rows that repeat an id and language, one, that of the smallest hash of its text.

    Null ids, texts and languages are left out; ties in the order of the ids' hashes go by id. Without labelled rows the model has no language and everything is UNKNOWN; the number of languages isn't bounded.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).filter("l is not null and t is not null")
    ids = labelled.filter(~base.held_out(F.col("id"))).groupBy("l", "id").agg(F.min(F.xxhash64("t")).alias("h"))
    chosen = base.stash(base.first_of_each(ids, "l", "id", rows).filter("id is not null"))
    found = labelled.withColumn("h", F.xxhash64("t")).join(base.bounded(chosen, 64), ["id", "l", "h"]).groupBy("id", "l").agg(F.min("t").alias("t"))
    return Model([(r.t, r.l) for r in found.orderBy(F.xxhash64("t"), "t", "l").collect()])  # at most `rows` of each language


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with three further columns, whose names are returned: lang_pred, score, ambiguous.

    The whole text is read, a very long one in pieces; repeated rows are judged each for itself, and alike. lang_pred is UNKNOWN, with score 0, if the text is null or has no letter, or
    if the model learned no language. An empty table gives an empty result; if docs has columns of these names, the new ones get an underscore in front. A narrow pass: no shuffle, the model is of a fixed size.
    """
    names = base.fresh(docs, "lang_pred", "score", "ambiguous")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            for part, data, offsets in tb.chunks(batch, text_col):
                known = has_letter(data, offsets) & bool(model.languages)
                best, score, unsure = model.decode(data, offsets) if model.languages else (np.zeros(len(known), int), np.zeros(len(known)), known)
                langs = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(unsure & known)], names=[*part.schema.names, *names])

    return base.map_arrow(docs, run, schema), names


def keep_known(docs: DataFrame, **columns) -> DataFrame:
    """docs without those of unknown language; all columns stay. Ambiguous documents stay: they have a language."""
    found, (lang, *_) = identify(docs, fit(docs, **columns), columns.get("text_col", "text"))
    return found.filter(F.col(lang) != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


@base.query("op5_language")
def op5_language(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    found, _ = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", base.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
