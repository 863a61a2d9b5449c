import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiframe.operators import dataset, encoding, generation, sampling, vocabulary
from lexiframe.operators import next_token as m

L = 3
TEXTS = ["a frog hopped", "a frog hopped over one log", "a heron slept", "a heron slept under one log"] * 12


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    vocab = vocabulary.assign_ids(vocabulary.count_vocab(docs), 1, 100).cache()
    rows = dataset.context_windows(encoding.encode(docs, vocab, add_bos_eos=True), L)
    return vocab, rows.cache()


@pytest.fixture(scope="module")
def fitted(corpus):
    return m.fit_next_token_model(corpus[1], 2)


def brute_counts(rows, order):
    counts = Counter()
    for ctx, y in rows:
        for length in range(min(order, len(ctx)) + 1):
            counts[tuple(ctx[len(ctx) - length :]), y] += 1
    return counts


@pytest.mark.parametrize("order", [0, 1, 2])
def test_counts_of_all_context_lengths(spark, corpus, order):
    data = [([5, 6], 7), ([6], 7), ([], 4), ([5, 6], 8), ([4, 5, 6], 7)]
    own = spark.createDataFrame(data, "ctx array<int>, y int")
    for rows, pairs in ((own, data), (corpus[1], [(r.ctx, r.y) for r in corpus[1].collect()])):
        table = m.fit_next_token_model(rows, order).table.collect()
        expected = brute_counts(pairs, order)
        assert {(tuple(r.ctx), r.token_id): r.n for r in table} == expected
        totals = Counter()
        for (ctx, _), n in expected.items():
            totals[ctx] += n
        assert all(r.p == pytest.approx(r.n / totals[tuple(r.ctx)]) for r in table)


def test_back_off_takes_the_longest_known_suffix(spark):
    rows = spark.createDataFrame([([5, 6], 7), ([8, 6], 9), ([5, 4], 4)], "ctx array<int>, y int")
    model = m.fit_next_token_model(rows, 2)
    asked = spark.createDataFrame([(0, [1, 5, 6]), (1, [9, 6]), (2, [6, 9]), (3, [])], "k int, ctx array<int>")
    known = {r.k: r.known for r in m.with_known_context(asked, model).collect()}
    assert known == {0: [5, 6], 1: [6], 2: [], 3: []}
    scored = {(r.k, r.token_id): r.p for r in m.predict_proba(asked, model, ("k",)).collect()}
    assert scored[0, 7] == 1.0 and scored[1, 7] == scored[1, 9] == 0.5 and scored[2, 4] == pytest.approx(1 / 3)


def test_report_equals_a_loop(spark):
    train = [([5, 6], 7), ([5, 6], 7), ([5, 6], 8), ([8, 6], 9)]
    asked = [("val", [5, 6], 8), ("val", [9, 6], 7), ("val", [4, 4], 3), ("train", [5, 6], 7), ("train", [5, 6], 7)]
    model = m.fit_next_token_model(spark.createDataFrame(train, "ctx array<int>, y int"), 2)
    rows = spark.createDataFrame(asked, "split string, ctx array<int>, y int")
    report = {r.split: r for r in m.model_report(rows, model, 10, order=2).collect()}
    losses = [-math.log(1 / 3), -math.log(2 / 4), -math.log(1e-15)]
    assert report["val"].n_rows == 3 and report["val"].accuracy == pytest.approx(1 / 3)
    assert report["val"].logloss == pytest.approx(sum(losses) / 3, rel=1e-9)
    assert report["train"].accuracy == 1.0 and report["train"].perplexity == pytest.approx(1.5) and report["train"].order == 2


def test_no_rows(spark):
    none = spark.createDataFrame([], "ctx array<int>, y int")
    model = m.fit_next_token_model(none, 2)
    assert model.table.count() == 0 and m.model_report(none, model, 10, ()).first().n_rows is None
    asked = spark.createDataFrame([([1], 2)], "ctx array<int>, y int")
    row = m.score_targets(asked, model, 10).first()
    assert row.y_pred is None and row.loss == pytest.approx(math.log(10))


def test_save_and_load(spark, fitted, tmp_path):
    m.save_model(fitted, str(tmp_path / "m"))
    loaded = m.load_model(spark, str(tmp_path / "m"))
    assert loaded.order == 2
    for a, b in ((fitted.table, loaded.table), (fitted.heads, loaded.heads)):
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_generation(spark, corpus, fitted):
    vocab, _ = corpus
    prompts = spark.createDataFrame([(0, "a heron"), (1, "a frog"), (2, "a heron slept under one log")], "prompt_id long, prompt string")
    scorer = generation.model_scorer(fitted)
    out = generation.generate_batch(prompts, vocab, scorer, L, max_new_tokens=2).orderBy("prompt_id").collect()
    assert [r.generated.split()[:3] for r in out[:2]] == [["a", "heron", "slept"], ["a", "frog", "hopped"]]
    with pytest.raises(ValueError, match="beam"):
        generation.generate_batch(prompts, vocab, scorer, L, sampling="beam")


def test_every_sample_of_a_prompt_is_drawn_by_itself(spark, corpus, fitted):
    prompts = spark.createDataFrame([(i, "a") for i in range(20)], "prompt_id long, prompt string")
    settings = {"num_samples": 3, "max_new_tokens": 1, "sampling": "top_k", "top_k": 2}
    out = generation.generate_batch(prompts, corpus[0], generation.model_scorer(fitted), L, **settings).collect()
    assert len(out) == 60 and all(len(r.generated.split()) == 2 for r in out)
    texts = {}
    for r in out:
        texts.setdefault(r.prompt_id, set()).add(r.generated)
    assert any(len(t) == 2 for t in texts.values())


def test_draw_with_a_key_named_like_its_output(spark):
    scored = spark.createDataFrame([(0, i, t, 0.5) for i in (0, 1) for t in (4, 5)], "prompt_id int, sample_idx int, token_id int, p double")
    drawn = sampling.sample_tokens(scored, "temperature", ctx=("prompt_id", "sample_idx"))
    assert drawn.columns == ["prompt_id", "sample_idx", "token_id"] and {r.sample_idx for r in drawn.collect()} == {0, 1}


def test_finished_rows_stop_at_eos(spark):
    vocab = spark.createDataFrame([(3, "<EOS>"), (4, "a"), (5, "b")], "id int, token string")

    def scorer(rows, keys):
        last = F.element_at("ctx", -1)
        following = F.when(last == 4, 5).otherwise(3)
        return rows.select(*keys, following.alias("token_id"), F.lit(1.0).alias("p"))

    rows = spark.createDataFrame([(0, 0, [2, 4]), (0, 1, [2, 5])], "conv_id long, turn long, ctx array<int>")
    state = generation.continue_ids(rows.withColumnRenamed("ctx", "ids"), scorer, 2, ("conv_id", "turn"), 5)
    assert {r.turn: r.new_ids for r in state.collect()} == {0: [5, 3], 1: [3]}
    free = generation.continue_ids(
        rows.withColumnRenamed("ctx", "ids"), scorer, 2, ("conv_id", "turn"), 3, stop_at_eos=False
    )
    assert {r.turn: r.new_ids for r in free.collect()} == {0: [5, 3, 3], 1: [3, 3, 3]}
    replies = generation.generate_replies(rows, vocab, scorer, 2, max_new_tokens=5)
    assert {r.turn: r.reply for r in replies.collect()} == {0: "b", 1: ""}
