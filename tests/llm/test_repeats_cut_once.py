"""A filter on the result of ``remove_repeats`` cuts no text a second time, and long texts need no large matrix."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lexiframe.llm import repeats
from lexiframe.llm.words import BASES, Powers


def test_texts_are_cut_once(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage), (2, f"a b {passage} c"), (3, passage), (4, None), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = repeats.remove_repeats(docs)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select("doc_id", "kept_text")
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {tuple(r) for r in left.collect()} == {(1, passage), (2, "a b c"), (4, None), (None, "x y")}


def test_anchors_of_a_long_text_take_little_memory(monkeypatch):
    hashes = np.random.default_rng(7).integers(0, 2**63, 60_000).astype(np.uint64)
    powers = Powers(BASES[0])
    repeats.anchors(hashes, powers, 50, 12)  # grows the powers
    tracemalloc.start()
    found = repeats.anchors(hashes, powers, 50, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000
    monkeypatch.setattr(repeats, "CHUNK", len(hashes))
    for a, b in zip(found, repeats.anchors(hashes, powers, 50, 12)):
        assert np.array_equal(a, b)
