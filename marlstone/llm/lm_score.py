"""Cross-entropy difference of two n-gram models with one vocabulary."""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from . import textbytes as tb

#: Words and pairs are told apart by all 64 bits of their hashes; words that a model hasn't seen share the uniform distribution over these.
WORDS, PAIRS = 1 << 64, 1 << 64
#: Bytes of text in a block, whose distinct words and pairs are looked up together, and bytes of the input for each part of the table of counts.
BLOCK_BYTES, PART_BYTES = 8 << 20, 8 << 20
#: Weight of the shorter context: counts that the word's own probability, and the uniform one, stand for.
PRIOR_PAIR, PRIOR_WORD = 20.0, 1000.0
KINDS = ("word", "context", "pair")


def hashes(words: tb.Words) -> dict[str, np.ndarray]:
    """Hash of each word, of the word before it (0 at the start of a document), and of the pair."""
    before = np.concatenate((np.zeros(1, np.uint64), words.hash[:-1])) if len(words.hash) else words.hash
    before[words.first[:-1][words.counts > 0]] = 0
    return dict(zip(KINDS, (words.hash, before, tb.mix(before * np.uint64(0x9E3779B97F4A7C15) + words.hash)), strict=True))


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, rows): docs (any columns, text, target) in blocks of BLOCK_BYTES of text, each as compressed Arrow data."""

    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            nonlocal block, held, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                for part in held:
                    to.write_batch(part)
            block, held, size = block + 1, [], 0
            return pa.RecordBatch.from_pydict({"block": pa.array([block - 1]), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            for part, data, _ in tb.chunks(batch, "text", BLOCK_BYTES, 1 << 20):
                held.append(part)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield out()
        if held:
            yield out()

    return base.map_arrow(docs, run, "block long, rows binary")


def _read_block(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all().combine_chunks()


def _distinct(parts: int):
    """A function that gives the hashes and counts (target, all) of each block's distinct words, contexts and pairs, cut by the hash into parts."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

    def run(batches):
        for batch in batches:
            for block, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = _read_block(rows)
                words = tb.tokenize(*tb.buffers(rows["text"]), tb.ALNUM)
                good = np.repeat(rows["target"].to_numpy().astype(bool), words.counts)
                for kind, h in hashes(words).items():
                    each, at = np.unique(h, return_inverse=True)
                    counts = np.stack([np.bincount(at[good], minlength=len(each)), np.bincount(at, minlength=len(each))]).astype(np.int64)
                    cut = np.concatenate(([0], np.searchsorted(each, edges), [len(each)]))
                    some = np.flatnonzero(np.diff(cut))
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array(np.full(len(some), block, np.int64)), "kind": pa.array([kind] * len(some), pa.string()), "part": pa.array(some.astype(np.int32)),
                        "hashes": pa.array([_pack_hashes(each[cut[i] : cut[i + 1]]) for i in some], pa.binary()), "counts": pa.array([_pack(counts[:, cut[i] : cut[i + 1]]) for i in some], pa.binary()),
                    })

    return run


def _pack_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, whose bytes of one place stand together."""
    return zlib.compress(np.ascontiguousarray(np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_hashes(h: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(h), np.uint8).reshape(8, -1).T).view(np.uint64).ravel())


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(np.ascontiguousarray(counts, np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(counts: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(counts), np.uint8).reshape(8, -1).T).view(np.int64).reshape(2, -1)


def _add(key, table):
    """One part of the table of counts, and from it the answers to the blocks, in the order of their hashes."""
    blocks, counts = table["block"].to_pylist(), table["counts"].to_pylist()
    asked = [_unpack_hashes(h) for h in table["hashes"].to_pylist()]
    every, at = np.unique(np.concatenate(asked), return_inverse=True)
    total, cut = np.zeros((2, len(every)), np.int64), np.cumsum([0, *(len(h) for h in asked)])
    for i, c in enumerate(counts):
        total[:, at[cut[i] : cut[i + 1]]] += _unpack(c)  # hashes are distinct within a block
    answers = [_pack(total[:, at[cut[i] : cut[i + 1]]]) for i in range(len(blocks))]
    answers.append(_pack(total.sum(1, keepdims=True)))  # block -1: how many words the part counts
    blocks.append(-1)
    return pa.table({"block": pa.array(blocks, pa.int64()), "kind": pa.array([key[0].as_py()] * len(blocks), pa.string()), "part": pa.array([key[1].as_py()] * len(blocks), pa.int32()), "counts": pa.array(answers, pa.binary())})


def losses(counts: dict[str, np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each token in nats under the target's model and under that of all documents, from the counts (target, all) of its word, context and pair.

    The counts of all documents are scaled to as many words as the target has, so that smoothing weighs the same in both.
    """
    out = []
    for m, scale in enumerate((1.0, float(n[0] / n[1]) if n[1] else 1.0)):
        word, seen, pair = (counts[k][m] * scale for k in KINDS)
        p = (word + PRIOR_WORD / WORDS) / (n[m] * scale + PRIOR_WORD)
        out.append(-np.log((np.minimum(pair, seen) + PRIOR_PAIR * p) / (seen + PRIOR_PAIR)))
    return out[0], out[1]


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with four further columns, whose names are returned: n_tokens, ce_target, ce_background, score = ce_target - ce_background.

    The lower the score, the more a document is like the target documents, those whose id is in target_ids; the background is all
    documents. Cross-entropies are means over the words; a document without words has none: null. With no target documents both
    models are alike but for the scale: its counts are empty and its losses those of the uniform model.
    The table of counts grows with the corpus and is nowhere whole: documents are written in blocks, each of which hands its distinct words and pairs on, cut by the hash
    into parts; a part adds up its counts and answers the blocks, which come together with their documents by a shuffle. No task holds
    more than a block or a part, so a very long text is a block of its own. Rows that are repeated count as often as they are there; repeated or null target ids count once or not at all. The ids are broadcast if they fit, else joined by a shuffle.
    An empty table gives an empty result; columns of docs may have any names.
    """
    ids = base.stash(target_ids.select(F.col(target_ids.columns[0]).alias("id")).filter("id is not null").distinct())
    names = base.fresh(docs, "n_tokens", "ce_target", "ce_background", "score")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(base.bounded(ids.withColumn("target", F.lit(True)), 32), "id", "left")
    others = F.struct(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text_col)).alias("row") if len(docs.columns) > 1 else F.lit(0).alias("row")
    rows = rows.select(others, "text", F.coalesce("target", F.lit(False)).alias("target"))
    blocks = base.stash(_blocks(rows))
    asked = base.map_arrow(blocks, _distinct(base.input_bytes(docs) // PART_BYTES + 8), "block long, kind string, part int, hashes binary, counts binary")
    answers = base.stash(asked.groupBy("kind", "part").applyInArrow(_add, "block long, kind string, part int, counts binary"))
    sums = base.map_arrow(answers.filter("kind = 'word' and block < 0").select("counts"), _sums, "target long, every long")
    n = np.array(sums.agg(F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0))).first(), np.int64)
    new = [T.StructField(names[0], T.LongType()), *(T.StructField(x, T.DoubleType()) for x in names[1:])]

    def run(texts, answers):
        found: dict = {}
        for kind, _, c in sorted(zip(*(answers[k].to_pylist() for k in ("kind", "part", "counts")), strict=True), key=lambda x: x[:2]):
            found.setdefault(kind, []).append(_unpack(c))
        texts = _read_block(texts["rows"][0].as_py())
        words = tb.tokenize(*tb.buffers(texts["text"]), tb.ALNUM)
        size = words.counts
        counts = {kind: np.concatenate(found[kind], 1)[:, np.unique(h, return_inverse=True)[1]] if len(h) else np.zeros((2, 0)) for kind, h in hashes(words).items()}
        with np.errstate(divide="ignore", invalid="ignore"):
            ce = [np.bincount(words.doc, x, len(size)) / size for x in losses(counts, n)]
        columns = [pa.array(size.astype(np.int64)), *(pa.array(x, mask=size == 0) for x in (*ce, ce[0] - ce[1]))]
        return pa.table([texts["row"], texts["text"], *columns], names=["row", "text", *names])

    texts = blocks.groupBy("block")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name in ("row", "text")), *new])
    base.ship(docs.sparkSession)
    scored = texts.cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(run, schema)
    kept = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return scored.select(*kept, *names), names


def _sums(batches):
    for batch in batches:
        n = sum((_unpack(c).sum(1) for c in batch.column(0).to_pylist()), np.zeros(2, np.int64))
        yield pa.RecordBatch.from_pydict({"target": pa.array([int(n[0])]), "every": pa.array([int(n[1])])})


@base.query("op1_lm_score")
def op1_lm_score(spark, sf_dir):
    good = base.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    found, names = score(base.table(spark, sf_dir, "documents").select("doc_id", "text"), good)
    return found.select("doc_id", *names)
