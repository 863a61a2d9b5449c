import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiframe.operators import vocabulary as v


def as_counts(spark, counter):
    return spark.createDataFrame(list(counter.items()), "token string, count long")


def test_counts_and_order(docs):
    counts = {r.token: r["count"] for r in v.count_vocab(docs).collect()}
    assert counts["one"] == 5 and counts["heron"] == 2
    kept = [(r.token, r["count"]) for r in v.build_vocab(v.count_vocab(docs), 2, None).collect()]
    assert kept == [("one", 5), ("frog", 2), ("heron", 2), ("slept", 2), ("under", 2)]
    top = v.assign_ids(v.count_vocab(docs), 2, 2).orderBy("id").collect()
    assert [(r.id, r.token) for r in top] == [
        (0, "<PAD>"), (1, "<UNK>"), (2, "<BOS>"), (3, "<EOS>"), (4, "one"), (5, "frog"),
    ]


def test_unlimited_ids_equal_limited_ones(docs):
    counts = v.count_vocab(docs)
    every = sorted(map(tuple, v.assign_ids(counts, 1, None).collect()))
    assert every == sorted(map(tuple, v.assign_ids(counts, 1, 1000).collect()))
    assert [r[0] for r in every] == list(range(len(every)))


def test_custom_tokenizer(docs):
    counts = v.count_vocab(docs, tokenizer=lambda t: F.array(F.substring(t, 1, 3)))
    assert [tuple(r) for r in counts.collect()] == [("one", 3)]


def test_pandas_udf_as_tokenizer(spark, docs):
    @F.pandas_udf("array<string>")
    def letters(s):
        return s.map(list)

    counts = {r.token: r["count"] for r in v.count_vocab(docs, tokenizer=letters).collect()}
    assert counts == Counter("".join(r.text for r in docs.collect()))


def test_oov(spark, docs):
    counts = v.count_vocab(docs)
    vocab = v.assign_ids(counts, 2, None)
    row = v.oov_stats(counts, vocab).first()
    assert (row.total_tokens, row.oov_tokens, row.oov_types) == (18, 5, 5)
    assert row.oov_rate == pytest.approx(500 / 18)
    assert [r.token for r in v.sample_oov_words(counts, vocab, 2).collect()] == ["and", "log"]
    empty = v.oov_stats(counts.where("false"), vocab).first()
    assert tuple(empty) == (0, 0, 0.0, 0)
    assert {r.token for r in v.in_vocab(counts, vocab).collect()} == {"one", "frog", "heron", "slept", "under"}


def test_sampled_docs(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    first = v.oov_sample_docs(docs, 7)
    assert sorted(r.doc_id for r in first.collect()) == list(range(7))
    a = {r.doc_id for r in v.oov_sample_docs(docs, 50, seed=1).collect()}
    assert len(a) == 50 and a == {r.doc_id for r in v.oov_sample_docs(docs, 50, seed=1).collect()}
    assert a != {r.doc_id for r in v.oov_sample_docs(docs, 50, seed=2).collect()}


def loop_cutoff(counter, percent):
    total, cum, size, freq = sum(counter.values()), 0, 0, 1
    for freq in sorted(counter.values(), reverse=True):
        cum += freq
        size += 1
        if cum >= total * (percent / 100.0):
            break
    return size, freq, cum / total * 100


@pytest.mark.parametrize("percent", [0.5, 10.0, 50.0, 80.0, 95.0, 99.9, 100.0])
def test_coverage_equals_loop(spark, percent):
    rng = random.Random(3)
    for counter in (
        Counter({f"w{i}": math.ceil(3000 / (i + 1)) for i in range(300)}),
        Counter({f"w{i}": rng.randint(1, 9) for i in range(100)}),
        Counter({f"w{i}": 5 for i in range(10)}),
    ):
        counts = as_counts(spark, counter)
        row = v.coverage_cutoff(counts, percent).first()
        size, freq, covered = loop_cutoff(counter, percent)
        assert (row.vocab_size, row.min_freq) == (size, freq)
        assert row.coverage == pytest.approx(covered)
        stats = v.coverage_stats(counts, percent).first()
        ties = [f for f in counter.values() if f >= freq]
        assert stats.final_size == len(ties)
        assert stats.final_coverage == pytest.approx(sum(ties) / sum(counter.values()) * 100)


def test_coverage_vocab_holds_all_ties(spark):
    vocab = v.coverage_vocab(as_counts(spark, Counter({f"w{i}": 5 for i in range(10)})), 50.0)
    assert vocab.where("id >= 4").count() == 10


def test_histogram(docs):
    rows = v.frequency_histogram(v.count_vocab(docs), None).collect()
    assert [(r.frequency, r.n_types) for r in rows] == [(5, 1), (2, 4), (1, 5)]
    assert sum(r.coverage for r in rows) == pytest.approx(100.0)


def test_build_stats(docs):
    row = v.build_stats(docs, 2, None, check_docs=1).first()
    assert (row.n_documents, row.vocab_size, row.total_tokens, row.unique_tokens) == (3, 5, 18, 10)
    assert (row.oov_check_tokens, row.oov_tokens) == (6, 1)


def test_stats_follow_case_and_tokenizer(spark, tmp_path):
    from lexiframe.plans import jobs

    docs = spark.createDataFrame([(0, "Oak oak-leaf"), (1, "oak Elm")], "doc_id long, text string")
    plain = jobs.build_vocabulary(docs, str(tmp_path / "cased"), min_freq=1, lowercase=False)
    stats = spark.read.json(str(tmp_path / "cased" / "stats")).first()
    assert (stats.vocab_size, stats.unique_tokens, stats.oov_tokens) == (plain.count() - 4, plain.count() - 4, 0)

    def spaces(text):
        return F.split(text, " ")

    own = jobs.build_vocabulary(docs, str(tmp_path / "own"), min_freq=1, tokenizer=spaces)
    stats = spark.read.json(str(tmp_path / "own" / "stats")).first()
    assert (stats.vocab_size, stats.total_tokens, stats.oov_tokens) == (4, 4, 0) and own.count() == 8
    rows = jobs.make_dataset(docs, str(tmp_path / "own"), str(tmp_path / "data"), 2, shuffle=False, tokenizer=spaces)
    assert rows.where("y = 1").isEmpty()


@pytest.mark.parametrize("top_k", [1, 7, 30, 59, 60, 61, 500])
@pytest.mark.parametrize("small", [10_000, 3])
def test_threshold_equals_a_full_sort(spark, monkeypatch, top_k, small):
    """Most words tie; the cut falls inside, at the end and beyond the ties."""
    monkeypatch.setattr(v, "SMALL_LIMIT", small)
    rng = random.Random(top_k)
    counter = {f"w{i:02}": rng.choice([1, 2, 2, 2, 3, 9]) for i in range(70)}
    counter = {w: c for w, c in counter.items() if c > 1} | {"rare": 1}
    expected = sorted(((w, c) for w, c in counter.items() if c >= 2), key=lambda x: (-x[1], x[0]))[:top_k]
    counts = as_counts(spark, counter)
    assert [tuple(r) for r in v.build_vocab(counts, 2, top_k).collect()] == expected
    ids = v.assign_ids(counts, 2, top_k).where("id >= 4").orderBy("id").collect()
    assert [(r.id, r.token, r["count"]) for r in ids] == [(i, *e) for i, e in enumerate(expected, 4)]


def test_no_task_gets_the_first_rows_of_all_others(spark):
    """A limit of 20,000 is no top-n of 20,000 rows per partition."""
    counts = spark.range(60_000).selectExpr("concat('w', id) AS token", "if(id < 100, 9, 2) AS count")
    plan = v.build_vocab(counts, 2, 20_000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    assert v.build_vocab(counts, 2, 20_000).count() == 20_000
