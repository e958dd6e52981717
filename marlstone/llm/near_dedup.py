"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from . import textbytes as tb

#: Words of a shingle, and the least Jaccard similarity of two sets of shingles that links their documents.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and registers in each: sets of similarity 0.8 share a band but for one case in 10,000.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Documents of a group that are compared with each other in one task, twice over at most, and words of theirs.
BLOCK, BLOCK_WORDS = 400, 1 << 20
#: Documents that are signed together: arrivals take some 25 KB for each.
TOGETHER = 256
#: One in so many shingles of a set is looked at beyond those of which like sets share one: like sets share as many more.
FURTHER = 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles, by document and hash. Fewer words than a shingle takes make one."""
    n = words.counts
    grams = tb.rolling(words.hash, SHINGLE)
    ok = tb.window_starts(words.first, SHINGLE)
    doc, h = words.doc[: len(grams)][ok], grams[ok]
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
        whole = tb.rolling(words.hash[words.first[d] : words.first[d + 1]], int(n[d]))
        doc, h = np.append(doc, d), np.append(h, whole)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, int)
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def fingerprints(doc: np.ndarray, h: np.ndarray, n: int) -> list[bytes | None]:
    """128 bits of each document's set of shingles; None if it has none."""
    out = np.zeros((n, 2), np.uint64)
    cut = np.flatnonzero(np.diff(doc, prepend=-1))
    if len(cut):
        for k in (0, 1):
            out[doc[cut], k] = np.add.reduceat(tb.mix(h * _GOLD + np.uint64(k + 1)), cut)
    some = np.zeros(n, bool)
    some[doc] = True
    return [out[i].tobytes() if some[i] else None for i in range(n)]


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash: (n, REGISTERS) hashes of shingles.

    A shingle arrives in a Poisson process of its own, whose rate is its weight and whose gaps and registers follow from its
    hash. Each register keeps the first arrival. Arrivals after a time by which all registers should have one needn't be looked
    at; the few documents with a register left go on to twice that time. Two registers agree with the probability Jaccard similarity
    of the weighted sets.
    """
    out = np.zeros((n, REGISTERS), np.uint64)
    total = np.bincount(doc, weight, n)
    limit = REGISTERS * (np.log(REGISTERS) + 4) / np.maximum(total, 1e-9)
    alone = np.bincount(doc, minlength=n) == 1
    out[doc[alone[doc]]] = h[alone[doc], None]
    todo = np.flatnonzero(~alone[doc])
    while len(todo):
        d, x, w, t, turn = doc[todo], h[todo], weight[todo], np.zeros(len(todo)), 0
        keys, times, whose = [], [], []
        while len(d):
            turn += 1
            r = tb.mix(x + np.uint64(turn * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / w
            live = t <= limit[d]
            d, x, w, t, r = d[live], x[live], w[live], t[live], r[live]
            keys.append(d * REGISTERS + (tb.mix(r ^ _GOLD) % np.uint64(REGISTERS)).astype(np.int64))
            times.append(t)
            whose.append(x)
        keys, times, whose = np.concatenate(keys), np.concatenate(times), np.concatenate(whose)
        order = np.argsort(-times, kind="stable")
        filled = np.zeros(n * REGISTERS, bool)
        filled[keys] = True
        flat = out.reshape(-1)
        flat[keys[order]] = whose[order]  # the earliest is written last
        open_ = np.zeros(n, bool)
        open_[doc[todo]] = True
        open_ &= ~filled.reshape(n, REGISTERS).all(1)
        limit[open_] *= 2
        todo = todo[open_[doc[todo]]]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes; equal in documents that agree on a band's registers."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    acc = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        acc = tb.mix(acc * _GOLD + parts[:, :, k])
    return tb.mix(acc + np.arange(1, BANDS + 1, dtype=np.uint64))


def _shared(size):
    """How many shingles a set of that size shares with one like it, at least; rounding only makes it one less."""
    return np.ceil(SIMILAR * size - 1e-3).astype(np.int64)


def _least(doc: np.ndarray, h: np.ndarray, n: int) -> pa.ListArray:
    """The first shingles, by hash, of each document's set: one in FURTHER, and so many that in any order like sets share one of their first."""
    size = np.bincount(doc, minlength=n)
    taken = np.minimum(size, size - _shared(size) + 1 + size // FURTHER)
    at = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(taken)).astype(np.int32)), pa.array(h[at < taken[doc]].view(np.int64)))


def _sets(batches):
    for batch in batches:
        for part, data, offsets in tb.chunks(batch, "text"):
            doc, h, _ = shingles(tb.tokenize(data, offsets, tb.ALNUM))
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("node")), pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64)))], names=["node", "shingles"])


def _sign(batches):
    for batch in batches:
        for part, data, offsets in tb.chunks(batch, "text", rows=TOGETHER):
            doc, h, _ = shingles(tb.tokenize(data, offsets, tb.ALNUM))
            n = part.num_rows
            marks = fingerprints(doc, h, n)
            hashes = bands(signatures(doc, h, np.ones(len(h)), n)).view(np.int64)
            size = np.bincount(doc, minlength=n).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(hashes.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, pa.binary()), pa.array(size), lists, _least(doc, h, n)], names=["id", "rid", "fp", "size", "bands", "least"])


def jaccard(texts_a: pa.Array, texts_b: pa.Array) -> np.ndarray:
    """Similarity of the shingle sets of each pair of texts."""
    sides = []
    for texts in (texts_a, texts_b):
        doc, h, _ = shingles(tb.tokenize(*tb.buffers(texts), tb.ALNUM))
        sides.append((doc, h))
    doc, h = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((h, doc))
    twin = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    both = np.bincount(doc[order][1:][twin], minlength=len(texts_a))
    return both / np.maximum(1, np.bincount(doc, minlength=len(texts_a)) - both)


def _verify(batches):
    for batch in batches:
        a = batch.column(batch.schema.get_field_index("text_a"))
        at = 0
        for part, _, _ in tb.chunks(batch, "text_b"):
            ok = pa.array(jaccard(a.slice(at, part.num_rows), part.column(part.schema.get_field_index("text_b"))) >= SIMILAR - 1e-12)
            at += part.num_rows
            yield part.select(["a", "b"]).filter(ok)


def _compare(key, table):
    """Links between the documents of two blocks of a group that join different components: enough to join all that are linked."""
    table = table.combine_chunks()
    nodes, components, side = table["node"].to_pylist(), table["component"].to_pylist(), np.array(table["block"].to_pylist())
    doc, h, _ = shingles(tb.tokenize(*tb.buffers(table["text"]), tb.ALNUM))
    size, n = np.bincount(doc, minlength=len(nodes)), len(nodes)
    shared, at, often = np.unique(h, return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    keep = often[at] > 1
    doc, at = doc[keep], number[at[keep]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        i, j = np.searchsorted(at, (low, low + 2048))
        m = np.zeros((n, 2048), np.float32)
        m[doc[i:j], at[i:j] - low] = 1
        both += m @ m.T
    alike = both >= (SIMILAR - 1e-12) * (size[:, None] + size[None] - both)
    if key[1].as_py() != key[2].as_py():
        alike &= side[:, None] != side[None]
    parent = {c: c for c in components}

    def find(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links = []
    for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
        a, b = find(components[i]), find(components[j])
        if a != b:
            parent[a] = b
            links.append((nodes[i], nodes[j]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links lead to, for every node but the roots. links: (a, b), both long.

    In turn, each node moves to its smallest neighbour, or that one's, and the edges between where they moved to stay, until there are none: the largest node of
    every component goes each time, and of nodes numbered at random most do. Minima are combined in the map tasks and joined apart from
    their aggregation, by a broadcast or a join whose large partitions AQE can split, so that a node with very many links needs no task of its own.
    """
    ordered = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, moves = base.stash(ordered(links)), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = base.stash(both.groupBy("a").agg(F.min("b").alias("m")).filter("m < a").select(F.col("a").alias("node"), F.col("m").alias("to")))
        far = near.select(F.col("node").alias("to"), F.col("to").alias("root"))
        moves.append(base.stash(near.join(base.bounded(far, 32), "to", "left").select("node", F.coalesce("root", "to").alias("root"))))
        edges = base.stash(ordered(_moved(_moved(edges, moves[-1], "a"), moves[-1], "b")))
    out = moves.pop() if moves else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while moves:
        out = _followed(moves.pop(), out)
    return out


def _moved(df: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """df with the nodes of a column where a stashed table (node, root) moves them."""
    side = base.bounded(moves, 32).select(F.col("node").alias(column), F.col("root").alias("__to"))
    return df.join(side, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")


def _followed(first: DataFrame, then: DataFrame) -> DataFrame:
    """Two stashed tables (node, root), of which the second moves the first's roots and further nodes, as one."""
    return base.stash(_moved(first, then, "root").unionByName(then.join(base.bounded(first, 32), "node", "left_anti").select("node", "root")))


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """root after further links."""
    more = components(_moved(_moved(links, root, "a"), root, "b"))
    return _followed(root, base.stash(more))


def _stars(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of the members of each group to the smallest set in it, verified. members: (node, least, ...)."""
    pairs = members.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return base.stash(base.map_arrow(sides.select("a", "b", "text_a", "text_b"), _verify, "a long, b long"))


def _grouped(members: DataFrame) -> DataFrame:
    """(bucket, node, size) with the number n of the bucket's members, their words, and its smallest set; buckets of one go. A bucket's figures are combined in the map tasks, and its rows need no task of their own."""
    of = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min(F.struct("size", "node")).alias("least")).filter("n > 1")
    of = base.stash(of.select("bucket", "n", "words", F.col("least.node").alias("least")))
    return base.stash(base.semi_first(members, of, "bucket").select("bucket", "node", "size", "n", "words", "least"))


def _open(members: DataFrame, root: DataFrame) -> DataFrame:
    """members of the buckets that still hold several components, with the component of each; of buckets with the same members, one."""
    found = members.join(base.bounded(root, 32), "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
    several = found.groupBy("bucket", "n").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).filter("low <> high")
    several = base.stash(several.groupBy("who", "n").agg(F.min("bucket").alias("bucket")).select("bucket"))
    return base.stash(found.join(base.bounded(several, 32), "bucket"))


def _dealt(open_: DataFrame) -> DataFrame:
    """(bucket, i, j, node, component, block): each bucket's members in blocks of about BLOCK nodes or BLOCK_WORDS words, dealt to the pairs of blocks that are to be compared.

    Members of a bucket's largest component have blocks of their own, which needn't be compared with each other: each of them goes to the blocks of the others only.
    """
    each = open_.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("size").alias("w"))
    main = base.stash(each.groupBy("bucket").agg(F.max(F.struct("c", "component", "w")).alias("main")))
    rows = open_.join(base.bounded(main, 48), "bucket").withColumn("rest", F.col("component") != F.col("main.component"))
    blocks = lambda n, words: F.ceil(F.greatest(n / BLOCK, words / BLOCK_WORDS)).cast("int")
    whole = blocks(F.col("n"), F.col("words")) <= 1  # such a bucket is one block
    rows = rows.withColumns({"few": F.when(whole, 1).otherwise(blocks(F.col("n") - F.col("main.c"), F.col("words") - F.col("main.w"))), "many": F.when(whole, 0).otherwise(blocks(F.col("main.c"), F.col("main.w")))})
    few, many, at = F.col("few"), F.col("many"), F.xxhash64("node")
    rows = rows.withColumn("block", F.when((many == 0) | F.col("rest"), F.pmod(at, few)).otherwise(few + F.pmod(at, F.greatest(many, F.lit(1)))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), few + many).otherwise(few) - 1))
    return rows.select("bucket", "node", "component", "block", other.alias("other")).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _compared(members: DataFrame, root: DataFrame, texts: DataFrame) -> DataFrame:
    """root after the links within the buckets of members, which are compared in full where they hold several components."""
    open_ = _open(members, root)
    if open_.isEmpty():
        return root
    base.ship(members.sparkSession)
    grouped = _dealt(open_).join(texts, "node").select("bucket", "i", "j", "node", "component", "block", "text").groupBy("bucket", "i", "j")
    more = base.stash(grouped.applyInArrow(_compare, "a long, b long"))
    return root if more.isEmpty() else _joined(root, more)


def _unbanded(signed: DataFrame, nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, size, ...) of buckets in which any two like sets meet, share they a band or not, and the texts (node, text) of their nodes.

    Of two sets that link, each shares _shared() of its shingles at least. So in any order of all shingles, the first k that they share are among the first
    size - _shared(size) + k of either set. First by hash: a set of which too few of those stand in another set's has no link, and most go. Then, among the sets left, the rarest
    shingles first: of each set those are its buckets of which a like set shares one. Those that no other set holds come first of all and need no bucket.
    """
    places = signed.filter("fp is not null").select("rid", F.xxhash64("fp").alias("set"), F.explode("least").alias("bucket"))
    twice = base.stash(places.groupBy("bucket").agg(F.min("set").alias("a"), F.max("set").alias("b")).filter("a <> b").select("bucket"))
    held = base.semi_first(places.select("rid", "bucket"), twice, "bucket").groupBy("rid").agg(F.count("*").alias("n"))
    shared = F.ceil(SIMILAR * F.col("size") - 1e-3)
    few = base.stash(held.join(nodes.select("rid", "node", "size"), "rid").filter(F.col("n") > F.floor(shared / FURTHER)).select("rid", "node", "size"))
    texts = base.stash(base.semi_first(rows.select("rid", "text"), few, "rid").select("node", "text").dropDuplicates(["node"]))
    sets = base.stash(base.map_arrow(texts, _sets, "node long, shingles array<long>"))
    each = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("bucket"))
    often = base.stash(each.groupBy("bucket").agg(F.count("*").alias("often")).filter("often > 1"))
    of = Window.partitionBy("node")
    ranked = base.semi_first(each, often, "bucket").withColumns({"known": F.count("*").over(of), "place": F.row_number().over(of.orderBy("often", "bucket"))})
    return _grouped(base.stash(ranked.filter(F.col("place") <= F.col("known") - shared + 1).select("bucket", "node", "size"))), texts


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, class_id (the smallest id of its class), kept (whether it is that row), and rid, a hash of id and text.

    Words are those of textbytes.ALNUM, lower-cased; a document is the set of its SHINGLE-word sequences (one of all its words if it has
    fewer). Documents whose sets have a Jaccard similarity of SIMILAR or more are linked, and classes are the connected
    components. Documents without words, null ones too, are classes of their own. Rows that repeat id and text are the same document,
    and all of them are kept or none. Texts of any length are read whole.

    1. Equal sets become one node; only nodes go on. The signatures weigh all shingles alike, so that a band's buckets follow the similarity that links.
    2. Every member of a band's bucket is verified against the smallest set in it.
    3. Buckets of any size that still hold several components are compared in full but within the largest component, in blocks of about BLOCK nodes or
       BLOCK_WORDS words, and the links that join components come out; buckets with the same members are compared once. So no link of a bucket is lost.
       A text of the largest component goes to as many tasks as the others have blocks, mostly one.
    4. Links whose sets share no band, some 0.7 in 10,000 of the least similar, are found by buckets of rare shingles (_unbanded), one of which any two like sets share;
       those are compared as in 3. So no link is lost.
    """
    rid = base.row_key(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), rid.alias("rid"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    signed = base.stash(base.map_arrow(rows, _sign, f"id {id_type}, rid long, fp binary, size int, bands array<long>, least array<long>"))
    nodes = signed.filter("fp is not null").groupBy("fp").agg(F.min(F.struct("id", "rid")).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = base.stash(nodes.select("fp", F.col("first.rid").alias("rid"), "size", "bands", F.monotonically_increasing_id().alias("node")))
    members = _grouped(nodes.select("node", "size", F.explode("bands").alias("bucket")))
    wanted = base.stash(members.select("node").distinct().join(nodes.select("node", "rid"), "node"))
    texts = base.stash(base.semi_first(rows.select("rid", "text"), wanted, "rid").select("node", "text"))
    root = _compared(members, components(_stars(members, texts)), texts)
    rest, texts = _unbanded(signed, nodes, rows)
    root = _compared(rest, root, texts)
    named = base.stash(root.join(nodes.select("fp", "node"), "node").select("fp", "root").unionByName(root.select(F.col("root").alias("node")).distinct().join(nodes.select("fp", "node"), "node").select("fp", F.col("node").alias("root"))))
    final = base.stash(signed.select("id", "rid", "fp").join(base.bounded(named, 64), "fp", "left").withColumn("class", F.when(F.col("root").isNull(), F.col("fp")).otherwise(F.col("root").cast("string").cast("binary"))))
    best = base.stash(final.filter("class is not null").groupBy("class").agg(F.min(F.struct("id", "rid")).alias("best"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    joined = final.join(base.bounded(best, 64), "class", "left")
    return joined.select(F.col("id").alias(id_col), F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("class_id"), F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True)).alias("kept"), "rid")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, that of the smallest id; all columns stay. Of rows that repeat the id and text, one stays; null and wordless texts are classes of their own."""
    (name,) = base.fresh(docs, "gone_rid")
    found = base.stash(near_classes(docs, id_col, text_col).groupBy(F.col("rid").alias(name)).agg(F.max("kept").alias("any"), F.count("*").alias("n")).filter("not any or n > 1"))
    key = base.row_key(F.col(id_col), F.col(text_col)) == F.col(name)
    kept = docs.join(base.bounded(base.stash(found.filter("not any").select(name)), 32), key, "left_anti")
    twice = base.stash(found.filter("any").select(name))
    if twice.isEmpty():
        return kept
    twice = base.bounded(twice, 32)
    ones = kept.withColumn(name, base.row_key(F.col(id_col), F.col(text_col))).join(twice, name, "left_semi").dropDuplicates([name]).drop(name)
    return kept.join(twice, key, "left_anti").unionByName(ones)


@base.query("op8_near_dedup")
def op8_near_dedup(spark, sf_dir):
    return near_classes(base.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
