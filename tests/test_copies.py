"""Copies in the shared folder live as long as something reads them."""

import os

from pyspark.sql import functions as F

from lexiframe.operators import dataset, encoding, generation, next_token, vocabulary
from lexiframe.session import copies_of, discard, materialize, recorded_copies, shared_dir


def copies(spark):
    folder = f"{shared_dir(spark).removeprefix('file:').replace('//', '/', 1)}/lexiframe"
    return {name for name in os.listdir(folder) if os.path.isdir(f"{folder}/{name}")} if os.path.isdir(folder) else set()


def test_discard_deletes_its_copies_only(spark):
    before = copies(spark)
    one, two = materialize(spark.range(5), "one"), materialize(spark.range(7), "two")
    assert len(copies(spark) - before) == 2
    discard(one, spark.range(3))
    left = copies(spark) - before
    assert len(left) == 1 and two.count() == 7
    discard(one, two)
    assert copies(spark) == before


def test_copies_of_a_block(spark):
    before = copies(spark)
    with copies_of(spark) as kept:
        inner = materialize(spark.range(10), "inner")
        with recorded_copies() as made:
            kept.append(materialize(inner.where("id > 3"), "kept"))
        assert len(made) == 1
    assert len(copies(spark) - before) == 1 and kept[0].count() == 6
    discard(*kept)
    assert copies(spark) == before


def test_generation_leaves_one_copy_of_its_state(spark):
    docs = spark.createDataFrame([(i, "a b a c a b d") for i in range(4)], "doc_id long, text string")
    vocab = vocabulary.assign_ids(vocabulary.count_vocab(docs), 1, 100)
    rows = dataset.context_windows(encoding.encode(docs, vocab, add_bos_eos=True), 2)
    scorer = generation.model_scorer(next_token.fit_next_token_model(rows))
    state = spark.createDataFrame([(i, [2, 4]) for i in range(6)], "prompt_id long, ids array<int>")
    before = copies(spark)
    out = generation.continue_ids(state, scorer, 2, ("prompt_id",), 5, "top_k", stop_at_eos=False)
    assert out.where(F.size("new_ids") == 5).count() == 6
    made = {name.split("-")[0] for name in copies(spark) - before if name.startswith("generated")}
    assert len([n for n in copies(spark) - before if n.startswith("generated")]) == 1 and made == {"generated"}


def test_draws_from_arrays_equal_draws_from_rows(spark):
    """The same tokens, for every way of sampling, by binary search and by the long form."""
    docs = spark.createDataFrame([(i, f"a b w{i % 5} a c w{i % 7} a b d") for i in range(40)], "doc_id long, text string")
    vocab = vocabulary.assign_ids(vocabulary.count_vocab(docs), 1, 100)
    rows = dataset.context_windows(encoding.encode(docs, vocab, add_bos_eos=True), 2)
    scorer = generation.model_scorer(next_token.fit_next_token_model(rows))
    state = spark.createDataFrame([(i, [2, 4 + i % 9]) for i in range(60)], "prompt_id long, ids array<int>").cache()
    for method, temperature in (("greedy", 1.0), ("top_k", 1.0), ("top_p", 0.7), ("temperature", 1.3)):
        settings = dict(max_new_tokens=2, sampling=method, temperature=temperature, top_k=3)
        by_arrays = generation.continue_ids(state, scorer, 2, ("prompt_id",), **settings).collect()
        by_rows = generation.continue_ids(state, lambda r, k: scorer(r, k), 2, ("prompt_id",), **settings).collect()
        assert sorted(map(tuple, by_arrays)) == sorted(map(tuple, by_rows))
