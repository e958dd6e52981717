"""Texts of a batch are looked up together, whatever chunks they are tokenized in."""

import random

import pyarrow as pa

from marlstone.llm import base, toxicity
from marlstone.llm import textbytes as tb


def test_a_batch_is_one_search(spark, monkeypatch):
    r, asked, real = random.Random(5), [], toxicity.Index.scores
    some = lambda n: " ".join(f"w{r.randrange(2000)}" for _ in range(n))
    index = toxicity.Index([(some(60), i % 2) for i in range(80)])
    texts = [some(500) for _ in range(300)] + [None, "", "no such term"]
    texts += texts[:20]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    assert batch.nbytes > 3 * tb.CHUNK_BYTES
    monkeypatch.setattr(toxicity.Index, "scores", lambda self, queries: asked.append(len(queries)) or real(self, queries))
    monkeypatch.setattr(base, "map_arrow", lambda df, f, schema: pa.Table.from_batches(f([batch])))
    found, (score, _, evidence) = toxicity.rate(spark.createDataFrame([], "doc_id long, text string"), index)
    assert asked == [301]
    assert found["doc_id"].to_pylist() == list(range(len(texts)))
    for t, s, why in zip(texts, found[score].to_pylist(), found[evidence].to_pylist(), strict=True):
        (query,) = index.vectors(*tb.buffers(pa.array([t], pa.string())))
        ((want, near),) = real(index, [query])
        assert s == want and [(x["cosine"], x["example"]) for x in why] == near
