import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import metrics as m
from lexiframe.operators import sampling as s


@pytest.fixture(scope="module")
def predictions(spark):
    y, guess = [0, 1, 2, 1, 0], [0, 1, 2, 2, 0]
    data = [(i, y[i], guess[i], [0.8 if c == y[i] else 0.1 for c in range(3)]) for i in range(5)]
    return spark.createDataFrame(data, "row_id long, y int, y_pred int, p array<double>")


def scored(spark, *rows):
    data = [(c, t, float(p)) for c, ps in enumerate(rows) for t, p in enumerate(ps)]
    return spark.createDataFrame(data, "ctx_id long, token_id int, p double")


def table(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.ctx_id, {})[r.token_id] = r.p
    return out


def test_metrics(predictions):
    assert m.accuracy(predictions).first().accuracy == 0.8
    assert m.multi_logloss(predictions).first().logloss == pytest.approx(-math.log(0.8))
    assert m.perplexity(predictions).first().perplexity == pytest.approx(1.25)
    report = m.metrics_report(predictions.withColumn("split", F.lit("val")), best_iteration=3).first()
    assert (report.n_rows, report.accuracy, report.best_iteration) == (5, 1.0, 3)


def test_logloss_clips_and_renormalises(spark):
    df = spark.createDataFrame([(0, [0.0, 2.0]), (1, [0.0, 2.0])], "y int, p array<double>")
    p = np.clip([0.0, 2.0], 1e-15, 1 - 1e-15)
    expected = -np.log(p / p.sum()).mean()
    assert m.multi_logloss(df).first().logloss == pytest.approx(expected)


@pytest.mark.parametrize("label", [-1, 3])
def test_label_outside_classes(spark, label):
    df = spark.createDataFrame([(label, [0.2, 0.3, 0.5])], "y int, p array<double>")
    with pytest.raises(Exception, match="invalid class label|INVALID_ARRAY_INDEX"):
        m.multi_logloss(df).collect()


def test_argmax_and_normalise(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.0, 0.0, 0.0],), ([1.0, 3.0, 0.0],)], "p array<double>")
    assert [r[0] for r in df.select(m.argmax_class(F.col("p"))).collect()] == [0, 0, 1]
    rows = [r[0] for r in df.select(m.normalise(F.col("p"))).collect()]
    assert rows[1] == [1 / 3] * 3 and rows[2] == [0.25, 0.75, 0.0]


def test_temperature(spark):
    df = scored(spark, [0.5, 0.3, 0.2])
    logits = np.log(np.array([0.5, 0.3, 0.2]) + 1e-10) / 0.5
    expected = np.exp(logits) / np.exp(logits).sum()
    got = table(s.apply_temperature(df, 0.5))[0]
    np.testing.assert_allclose([got[i] for i in range(3)], expected)
    assert s.apply_temperature(df, 1.0) is df and s.apply_temperature(df, 0) is df


def test_greedy_and_top_k(spark):
    df = scored(spark, [0.1, 0.3, 0.6], [0.4, 0.4, 0.2])
    assert {r.ctx_id: r.token_id for r in s.pick_greedy(df).collect()} == {0: 2, 1: 0}
    top = table(s.filter_top_k(scored(spark, [0.4, 0.3, 0.2, 0.1]), 2))[0]
    assert top == pytest.approx({0: 4 / 7, 1: 3 / 7})
    assert len(table(s.filter_top_k(df, 99))[0]) == 3


def loop_top_p(p, limit):
    order = np.argsort(-np.array(p), kind="stable")
    n = max(1, int(np.searchsorted(np.cumsum(np.array(p)[order]), limit, side="right")))
    return set(order[:n].tolist())


@pytest.mark.parametrize("limit", [0.05, 0.4, 0.5, 0.8, 0.9, 0.95, 1.0])
def test_top_p_leaves_out_the_crossing_token(spark, limit):
    rows = [[0.5, 0.3, 0.15, 0.05], [0.25] * 4, [0.1, 0.2, 0.3, 0.4], [0.05, 0.05, 0.8, 0.1]]
    got = table(s.filter_top_p(scored(spark, *rows), limit))
    for c, p in enumerate(rows):
        assert set(got[c]) == loop_top_p(p, limit)
        assert sum(got[c].values()) == pytest.approx(1.0)


def test_draws_follow_the_distribution(spark):
    df = scored(spark, [0.5, 0.3, 0.2], [0.0, 0.0, 1.0])
    draws = s.draw(df, seed=1, n_samples=3000).groupBy("ctx_id", "token_id").count().collect()
    share = {(r.ctx_id, r.token_id): r["count"] / 3000 for r in draws}
    assert share[(1, 2)] == 1.0
    np.testing.assert_allclose([share[(0, t)] for t in range(3)], [0.5, 0.3, 0.2], atol=0.04)
    again = [r.token_id for r in s.draw(df, seed=1, n_samples=5).orderBy("ctx_id", "sample_idx").collect()]
    assert again == [r.token_id for r in s.draw(df, seed=1, n_samples=5).orderBy("ctx_id", "sample_idx").collect()]


@pytest.mark.parametrize("method", s.METHODS)
def test_every_method_gives_one_token(spark, method):
    df = scored(spark, [0.1, 0.3, 0.6], [0.4, 0.4, 0.2])
    assert s.sample_tokens(df, method, temperature=0.8).count() == 2


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="draws"):
        s.sample_tokens(scored(spark, [1.0]), "beam")


def test_samples_per_prompt(spark):
    df = spark.createDataFrame([(7, "a")], "prompt_id long, prompt string")
    assert [r.sample_idx for r in s.samples_per_prompt(df, 3).collect()] == [0, 1, 2]
