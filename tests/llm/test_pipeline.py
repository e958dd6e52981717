"""The pipeline's stages, each against what its predecessor kept."""

import re

import corpus_pipeline
import test_decontaminate
import test_near
import test_packing


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123 !!", None, None, None), (10_003, "", "de", "s", 0)], docs.schema)
    docs = docs.unionByName(more)
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.base.stash(stage(spark, docs, sf))
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert set(before) - set(now) == {i for i, t in before.items() if not re.search(r"[^\W\d_]", t or "")}
        if name == "exact_dedup":
            fold = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)
            assert set(now) == set({fold(t): i for i, t in sorted(before.items())}.values())
        if name == "near_dedup":
            assert sorted(now) == [x[0] for x in sorted(test_near.brute(list(before.items())))]
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert sorted(now) == sorted(x[0] for x in test_decontaminate.brute(list(before.items()), items) if not x[-1])
        before = now
    assert test_packing.check(corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), before) > 0.9


def test_odd_tables(spark):
    """An empty table, and repeated rows with further columns whose names the operators use themselves."""
    sf = "/root/testdata/sf0.001"
    more = "doc_id long, text string, lang string, source string, n_chars long, rid string, kept int, score double, n_hit string, probe_place int"
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t, "en", "s", 0, "r", 1, 0.5, "h", 7) for i, t in ((1, text), (1, text), (2, text.upper()), (3, text + " more"), (4, None), (5, ""), (6, "one more text"), (6, "one more text"), (None, "no id at all"))]
    docs, empty = spark.createDataFrame(rows, more), spark.createDataFrame([], more)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = (corpus_pipeline.base.stash(stage(spark, d, sf)) for d in (docs, empty))
        assert docs.columns == empty.columns == [c.split()[0] for c in more.split(", ")] and empty.count() == 0
    kept = sorted((str(r.doc_id), r.text) for r in docs.collect())
    assert kept == sorted([("2", text.upper()), ("6", "one more text"), ("None", "no id at all")])
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, sf).count() == 3 and last(spark, empty, sf).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
