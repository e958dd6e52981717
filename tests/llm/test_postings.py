"""Postings of a query that are more than the numbers kept ready for them."""

import random

import numpy as np
import pyarrow as pa

from marlstone.llm import textbytes as tb
from marlstone.llm import toxicity


def test_more_postings_than_places():
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(40)) for _ in range(60)]
    index = toxicity.Index([(t, i % 2) for i, t in enumerate(texts)])
    queries = list(index.vectors(*tb.buffers(pa.array([*texts[:20], "", "w1"], pa.string()))))
    want = index.all_nearest(queries)
    index.places = np.arange(3)
    assert index.all_nearest(queries) == want and max(len(x) for x in want) == toxicity.NEIGHBOURS and want[20] == []
