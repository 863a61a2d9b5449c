"""The features of a context are made by one function; tables of the sizes in use go to the workers."""

import inspect
from math import inf, nan

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexiframe.operators import features as feat
from lexiframe.operators.feature_model import ContextFeatures
from lexiframe.registry import queries as q

DIM = 4


@pytest.fixture(scope="module")
def vectors(spark):
    m = np.random.RandomState(8).randn(9, DIM)
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m) if i != 5], "id int, vec array<float>")


def _options(**more):
    return feat.FeatureOptions(mean_pooled=True, prototypes=True, last_token=True, position_pooled=True, max_pooled=True, n_prototypes=2, top_k_similar=3, **more)


@pytest.mark.parametrize("reduce_to", [None, 2])
@pytest.mark.parametrize("ids_and_stats", [True, False])
def test_one_function_gives_what_columns_give(spark, vectors, monkeypatch, reduce_to, ids_and_stats):
    rng = np.random.RandomState(9)
    data = [(i, 1, [int(x) for x in rng.choice([0, 1, 2, 5, 6, 8, 40], 4)]) for i in range(40)]
    rows = spark.createDataFrame([*data, (40, 1, [0, 0, 0, 0])], "doc_id long, pos int, ctx array<int>")
    flags = dict.fromkeys(("token_ids", "context_length", "unk_count", "type_token_ratio"), ids_and_stats)
    options = _options(reduce_to=reduce_to, **flags)
    model = ContextFeatures(options, vectors).fit(rows)
    one, names, _ = model._assembled(rows)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    monkeypatch.setattr(feat, "_features_in_tasks", lambda *_: None)
    two, others, _ = model._assembled(rows)
    assert names == others and one.schema == two.schema
    a, b = ({r.doc_id: r.f for r in df.select("doc_id", vector_to_array("features").alias("f")).collect()} for df in (one, two))
    assert len(a) == 41 and len(a[0]) == len(names)
    for k in a:
        np.testing.assert_allclose(a[k], b[k], atol=1e-9)


def test_contexts_of_other_widths_and_only_statistics(spark, vectors):
    rows = spark.createDataFrame([(0, 1, [6, 8]), (1, 1, [1, 2, 6]), (2, 1, [])], "doc_id long, pos int, ctx array<int>")
    options = feat.FeatureOptions(last_token=True, top_k_similar=2)
    built = feat.assemble_features(rows, options, vectors)[0].select("doc_id", vector_to_array("features").alias("f"))
    found = {r.doc_id: r.f for r in built.collect()}
    assert found[0][:5] == [6, 8, 2, 0, 1] and found[1][:6] == [1, 2, 6, 3, 1, 1] and found[2] == [0, 0, 0, 0, 0]
    assert [len(found[k]) for k in range(3)] == [7, 8, 5]


def test_features_are_summed_up_where_they_are_made(spark, vectors):
    rows = spark.createDataFrame([(0, 1, [6, 8]), (1, 1, [1, 2])], "doc_id long, pos int, ctx array<int>")
    built = feat.assemble_features(rows, _options_without_prototypes(), vectors)[0]
    sums = built.select("doc_id", q.size_and_weighted_in_batches(F.col("features")).alias("s")).select("doc_id", "s.*")
    assert sums._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    f = vector_to_array("features")
    expected = {r.doc_id: r for r in built.select("doc_id", F.size(f).alias("n"), q.weighted(f).alias("v")).collect()}
    for r in sums.collect():
        assert r.n == expected[r.doc_id].n
        np.testing.assert_allclose(r.v, expected[r.doc_id].v)


def _options_without_prototypes():
    return feat.FeatureOptions(mean_pooled=True, last_token=True, position_pooled=True, max_pooled=True, top_k_similar=3)


def test_extremes_as_by_array_functions(spark):
    values = [[1.0, -2.0, 3.0], [nan, 1.0, 2.0], [nan, nan, nan], [inf, -inf, 0.0]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<double>")
    by_arrays = rows.select("i", F.array_min("v").alias("least"), F.array_max("v").alias("most"), F.size("v").alias("n"))
    in_batches = rows.select("i", q.extremes_in_batches(F.col("v")).alias("s")).select("i", "s.*")
    assert sorted(map(str, by_arrays.collect())) == sorted(map(str, in_batches.collect()))


def test_six_times_a_hundred_thousand_vectors_are_a_matrix():
    """Else pools go by blocks, with a row per context and block."""
    limit = inspect.signature(feat.pool_embeddings).parameters["max_bytes"].default
    assert limit == feat.MATRIX_BYTES >= 6 * 102_564 * 64 * 4
