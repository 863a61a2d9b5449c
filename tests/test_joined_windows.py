import numpy as np
import pytest

from lexiframe.operators.dataset import PIECE, context_windows
from lexiframe.operators.feature_model import ContextFeatures
from lexiframe.operators.features import EMPTY_MAX, FeatureOptions, matrix_if_small, pool_embeddings
from lexiframe.session import recorded_copies

DIM = 3


def _vectors(spark):
    rng = np.random.RandomState(3)
    rows = [(i, [float(x) for x in rng.randn(DIM)]) for i in range(9) if i != 5]
    return spark.createDataFrame(rows, "id int, vec array<float>")


def _documents(spark):
    rng = np.random.RandomState(4)
    rows = [(d, [2, *[int(x) for x in rng.randint(0, 11, n)], 3]) for d, n in enumerate((0, 1, PIECE - 1, PIECE, 3 * PIECE + 5))]
    return rows, spark.createDataFrame(rows, "doc_id long, ids array<int>")


@pytest.mark.parametrize("length", [1, 5, 16])
def test_windows_and_pools_equal_brute_force(spark, length):
    documents, encoded = _documents(spark)
    vecs = {r["id"]: np.array(r["vec"], np.float64) for r in _vectors(spark).collect() if r["id"] != 0}
    rows = pool_embeddings(context_windows(encoded, length), _vectors(spark), ("mean", "max", "position")).collect()
    single = {(r["doc_id"], r["pos"]): r for r in pool_embeddings(context_windows(encoded, length), _vectors(spark)).collect()}
    found = {(r["doc_id"], r["pos"]): r for r in rows}
    assert len(rows) == len(found) == sum(len(ids) - 1 for _, ids in documents)
    for doc, ids in documents:
        for pos in range(1, len(ids)):
            r = found[doc, pos]
            ctx = ([0] * length + ids[:pos])[-length:]
            assert (r["ctx"], r["y"]) == (ctx, ids[pos])
            known = [(j, vecs[i]) for j, i in enumerate(ctx) if i in vecs]
            weight = [np.exp(j / length) for j, _ in known]
            mean = np.mean([v for _, v in known], axis=0) if known else np.zeros(DIM)
            place = sum(w * v for w, (_, v) in zip(weight, known)) / sum(weight) if known else np.zeros(DIM)
            most = np.max([v for _, v in known], axis=0) if known else np.full(DIM, EMPTY_MAX)
            assert np.allclose(r["mean_pooled"], mean) and np.allclose(r["position_pooled"], place)
            assert np.allclose(r["max_pooled"], most) and np.allclose(single[doc, pos]["mean_pooled"], mean)


def test_rows_on_their_way_to_a_worker_do_not_carry_the_document(spark):
    _, encoded = _documents(spark)
    plan = pool_embeddings(context_windows(encoded, 16), _vectors(spark)).select("doc_id", "mean_pooled")
    text = plan._jdf.queryExecution().executedPlan().toString()
    sent = text[text.index("ArrowEvalPython") :].splitlines()[0]
    assert "_padded" not in sent


def test_a_fit_stores_no_pooled_vectors(spark):
    _, encoded = _documents(spark)
    options = FeatureOptions(mean_pooled=True, max_pooled=True, reduce_to=2)
    with recorded_copies() as made:
        model = ContextFeatures(options, _vectors(spark)).fit(context_windows(encoded, 4))
    assert set(model.pca) == {"mean", "max"} and not made


def test_of_a_large_table_only_the_vectors_in_use_go_to_workers(spark):
    _, encoded = _documents(spark)
    unused = spark.range(1000, 3000).selectExpr("int(id) AS id", "array(1f, 2f, 3f) AS vec")
    rows, vecs = context_windows(encoded, 4), _vectors(spark)
    kinds = ("mean", "max", "position")
    pooled = pool_embeddings(rows, vecs.unionByName(unused), kinds, max_bytes=200)
    assert "CoGroup" not in pooled._jdf.queryExecution().executedPlan().toString()
    assert sorted(pooled.collect()) == sorted(pool_embeddings(rows, vecs, kinds).collect())
    none = pool_embeddings(rows.where("doc_id < 0"), vecs.unionByName(unused), kinds, max_bytes=200)
    assert none.count() == 0


def test_the_matrix_is_collected_as_arrow(spark, monkeypatch):
    vecs = _vectors(spark)
    held = {r["id"]: r["vec"] for r in vecs.collect()}
    monkeypatch.setattr(type(vecs), "toPandas", lambda self: pytest.fail("vectors became Python lists"))
    matrix, present = matrix_if_small(vecs)
    assert matrix.dtype == np.float32 and present.tolist() == [i in held and i != 0 for i in range(9)]
    assert all(matrix[i].tolist() == (held[i] if present[i] else [0.0] * DIM) for i in range(9))
    for wrong in ("(9, array(1f, 2f))", "(9, null)", "(9, array(1f, 2f, null))", "(null, array(1f, 2f, 3f))"):
        more = spark.sql(f"SELECT int(col1) AS id, cast(col2 AS array<float>) AS vec FROM VALUES {wrong}")
        with pytest.raises(ValueError):
            matrix_if_small(vecs.unionByName(more))
