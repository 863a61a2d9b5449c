import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lexiframe.operators import embeddings as emb
from lexiframe.operators import features as feat
from lexiframe.operators.feature_model import ContextFeatures, ContextFeaturesModel

CONTEXTS = [[0, 0, 0, 5], [0, 2, 6, 3], [7, 5, 1, 2], [6, 6, 1, 1], [3, 1, 7, 7]]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, 1, c) for i, c in enumerate([*CONTEXTS, [0, 0, 0, 0]])]
    return spark.createDataFrame(data, "doc_id long, pos int, ctx array<int>").cache()


@pytest.fixture(scope="module")
def matrix():
    m = np.random.RandomState(0).randn(8, 10).astype(np.float32)
    m[0] = 0
    return m


@pytest.fixture(scope="module")
def vectors(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id int, vec array<float>")


def column(df, name):
    return np.array([r[0] for r in df.orderBy("doc_id").select(name).collect()], dtype=float)


def expected_pools(matrix):
    ids = np.array([*CONTEXTS, [0, 0, 0, 0]])
    vecs, mask = matrix[ids].astype(float), (ids != 0)[..., None]
    w = np.exp(np.arange(4) / 4)[None, :, None] * mask
    return {
        "mean": (vecs * mask).sum(1) / np.maximum(mask.sum(1), 1),
        "max": np.where(mask, vecs, -1e10).max(1),
        "position": (vecs * w).sum(1) / np.maximum(w.sum(1), 1e-10),
    }


def test_context_stats(rows):
    out = feat.with_context_stats(rows)
    assert column(out, "context_length").tolist() == [1, 3, 4, 4, 4, 0]
    assert column(out, "unk_count").tolist() == [0, 0, 1, 2, 1, 0]
    assert column(out, "type_token_ratio").tolist() == [1.0, 1.0, 1.0, 0.5, 0.75, 0.0]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_pools_in_tasks_and_by_join(rows, vectors, matrix, max_bytes):
    out = feat.pool_embeddings(rows, vectors, feat.POOLS, max_bytes=max_bytes)
    for kind, expected in expected_pools(matrix).items():
        np.testing.assert_allclose(column(out, f"{kind}_pooled"), expected, atol=1e-9)


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_pools_agree_on_gaps_and_widths(spark, max_bytes):
    vectors = spark.createDataFrame([(0, [9.0, 9.0]), (1, [1.0, -2.0]), (2, [3.0, 4.0])], "id int, vec array<float>")
    data = [(0, 1, [0, 4, 1, 2]), (1, 1, [2]), (2, 1, [7, 99]), (3, 1, []), (4, 1, [1, 2, 3]), (5, 1, None)]
    rows = spark.createDataFrame(data, "doc_id long, pos int, ctx array<int>")
    out = feat.pool_embeddings(rows, vectors, feat.POOLS, max_bytes=max_bytes).orderBy("doc_id").collect()
    assert [list(r.mean_pooled) for r in out] == [[2, 1], [3, 4], [0, 0], [0, 0], [2, 1], [0, 0]]
    low = [-1e10, -1e10]
    assert [list(r.max_pooled) for r in out] == [[3, 4], [3, 4], low, low, [3, 4], low]
    a, b = np.exp(2 / 4), np.exp(3 / 4)
    np.testing.assert_allclose(out[0].position_pooled, [(a + 3 * b) / (a + b), (-2 * a + 4 * b) / (a + b)])


@pytest.mark.parametrize("block", [1, 3, 4, 4096])
def test_nearest_of_ids_with_gaps(spark, block):
    ids = [0, 1, 2, 3, 10, 11, 20]
    m = np.random.RandomState(1).randn(len(ids), 5).astype(np.float32)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m)], "id int, vec array<float>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit @ unit.T
    got = {r.id: list(r.sims) for r in emb.nearest_similarities(table, 3, block).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        np.testing.assert_allclose(got[i], np.sort(np.delete(cos[k], k))[::-1][:3], atol=1e-6)


def test_unknown_pool(rows, vectors):
    with pytest.raises(ValueError, match="unknown pooling"):
        feat.pool_embeddings(rows, vectors, ("median",))


@pytest.mark.parametrize("block", [2048, 3, 1])
def test_nearest_similarities(vectors, matrix, block):
    m = matrix.astype(float)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -np.inf)
    expected = -np.sort(-cos, axis=1)[:, :5]
    got = {r.id: r.sims for r in emb.nearest_similarities(vectors, 5, block).collect()}
    np.testing.assert_allclose([got[i] for i in range(8)], expected, atol=1e-9)


def test_last_token_similarity(rows, vectors):
    got = column(emb.last_token_similarity(rows, vectors, 5), "last_token_sims")
    table = {r.id: r.sims for r in emb.nearest_similarities(vectors, 5).collect()}
    np.testing.assert_allclose(got, [table[5], table[3], table[2], table[1], table[7], [0.0] * 5])
    with pytest.raises(ValueError, match="top_k"):
        emb.nearest_similarities(vectors, 8)


def test_prototypes(rows, vectors):
    centres = feat.fit_prototypes(vectors, 3, n_init=2)
    assert centres.shape == (3, 10)
    sims = column(feat.prototype_similarity(feat.pool_embeddings(rows, vectors), centres), "prototype_sims")
    assert sims.shape == (6, 3) and np.abs(sims).max() <= 1 + 1e-9
    assert sims[5].tolist() == [0.0, 0.0, 0.0]


def test_pca(spark):
    m = np.random.RandomState(1).randn(60, 8) @ np.diag([5, 4, 3, 1, 1, 1, 1, 1]) + 3
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "doc_id long, v array<double>")
    reduced = column(feat.pca_reduce(df, "v", 2), "v")
    centred = m - m.mean(axis=0)
    expected = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    np.testing.assert_allclose(np.abs(reduced), np.abs(expected), atol=1e-6)
    assert column(feat.pca_reduce(df, "v", 8), "v").shape == (60, 8)


def test_align_embeddings(spark):
    words = ["<PAD>", "<UNK>", "<BOS>", "<EOS>", "the", "cat", "owl"]
    vocab = spark.createDataFrame(list(enumerate(words)), "id int, token string")
    vectors = spark.createDataFrame(
        [("the", [1.0, 0.0]), ("cat", [0.0, 1.0]), ("<EOS>", [9.0, 9.0]), ("<BOS>", [2.0, 2.0])], "token string, vec array<float>"
    )

    def aligned(**kw):
        return {r.token: r.vec for r in emb.align_embeddings(vocab, vectors, **kw).collect()}

    shared = np.random.RandomState(42).randn(2).astype(np.float32) * np.float32(0.1)
    got = aligned()
    assert got["the"] == [1.0, 0.0] and got["<PAD>"] == [0.0, 0.0] and got["<BOS>"] == [2.0, 2.0]
    for token in ("<UNK>", "<EOS>", "owl"):
        np.testing.assert_allclose(got[token], shared, rtol=1e-6)
    plain = aligned(unk_init="zero", special_rules=False)
    assert plain["<EOS>"] == [9.0, 9.0] and plain["owl"] == [0.0, 0.0]
    assert aligned(unk_init="mean")["owl"] == [3.0, 3.0]
    row = emb.embedding_coverage(emb.align_embeddings(vocab, vectors)).first()
    assert (row.vocab_size, row.n_found) == (7, 4)
    with pytest.raises(ValueError, match="components"):
        emb.align_embeddings(vocab, vectors, dim=3)
    with pytest.raises(ValueError, match="unk_init"):
        aligned(unk_init="ones")
    with pytest.raises(ValueError, match="for the"):
        emb.embedding_size_check(vectors.select(F.lit(1).alias("id"), "vec"), vocab)


def test_assembly(rows, vectors):
    _, names, categorical = feat.assemble_features(rows, feat.FeatureOptions())
    assert len(names) == 7 and categorical == ["token_t-4", "token_t-3", "token_t-2", "token_t-1"]
    options = feat.FeatureOptions(
        mean_pooled=True, prototypes=True, last_token=True, position_pooled=True, max_pooled=True,
        n_prototypes=2, top_k_similar=3, reduce_to=4,
    )
    with pytest.raises(ValueError, match="fitted"):
        feat.assemble_features(rows, options, vectors)
    model = ContextFeatures(options, vectors).fit(rows)
    built, names = model.transform(rows.where("doc_id < 5")), model.names
    values = column(built.select("doc_id", vector_to_array("features").alias("f")), "f")
    assert values.shape == (5, len(names)) == (5, 4 + 3 + 4 + 2 + 3 + 4 + 4)
    assert np.isfinite(values).all()
    options = feat.FeatureOptions(mean_pooled=True, prototypes=True, last_token=True, n_prototypes=2, top_k_similar=3)
    assert len(ContextFeatures(options, vectors).fit(rows).names) == 4 + 3 + 10 + 2 + 3
    only = feat.FeatureOptions(False, False, False, False, mean_pooled=True)
    assert len(feat.assemble_features(rows, only, vectors)[1]) == 10


def test_option_errors(rows, vectors):
    with pytest.raises(ValueError, match="need an embedding"):
        feat.assemble_features(rows, feat.FeatureOptions(mean_pooled=True))
    with pytest.raises(ValueError, match="no features"):
        feat.assemble_features(rows, feat.FeatureOptions(False, False, False, False))


@pytest.mark.parametrize(("block", "group_rows"), [(1, 1), (3, 2), (4, 50), (4096, 50_000)])
def test_pools_by_blocks_equal_the_matrix(spark, block, group_rows):
    """Gaps, IDs beyond the table, nulls and a hot ID, with blocks and groups of any size."""
    rng = np.random.RandomState(3)
    ids = [1, 2, 3, 5, 8, 9, 13]
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.randn(3)]) for i in ids], "id int, vec array<float>")
    data = [(i, j, [int(x) for x in rng.choice([0, 1, 1, 1, 2, 3, 4, 5, 8, 9, 13, 40], rng.randint(0, 7))]) for i in range(12) for j in range(3)]
    rows = spark.createDataFrame([*data, (99, 0, None), (None, 1, [1, 2])], "doc_id long, pos int, ctx array<int>")
    small = feat.pool_embeddings(rows, vectors, feat.POOLS).collect()
    blocks = feat.pool_by_blocks(rows, vectors, feat.POOLS, block=block, group_rows=group_rows)
    key = lambda r: (r.doc_id is None, r.doc_id, r.pos)
    for a, b in zip(sorted(small, key=key), sorted(blocks.collect(), key=key), strict=True):
        assert (a.doc_id, a.pos, a.ctx) == (b.doc_id, b.pos, b.ctx)
        for kind in feat.POOLS:
            np.testing.assert_allclose(a[f"{kind}_pooled"], b[f"{kind}_pooled"], atol=1e-12)


def test_feature_model_saved_and_loaded(spark, rows, vectors, tmp_path):
    """Fit on some rows, saved, loaded: equal features on others, none for no rows."""
    options = feat.FeatureOptions(
        mean_pooled=True, prototypes=True, last_token=True, position_pooled=True, max_pooled=True,
        n_prototypes=3, top_k_similar=2, reduce_to=4,
    )
    model = ContextFeatures(options, vectors).fit(rows.where("doc_id < 4"))
    model.save(str(tmp_path / "m"))
    loaded = ContextFeaturesModel.load(str(tmp_path / "m"))
    assert loaded.names == model.names and loaded.categorical == model.categorical
    others = rows.where("doc_id >= 3")
    one, two = (column(m.transform(others).select("doc_id", vector_to_array("features").alias("f")), "f") for m in (model, loaded))
    np.testing.assert_allclose(one, two)
    assert one.shape[1] == len(model.names)
    assert loaded.transform(rows.where("false")).collect() == []
    with pytest.raises(ValueError, match="at least one row"):
        ContextFeatures(options, vectors).fit(rows.where("false"))


def test_pca_of_all_components_keeps_lengths(spark):
    m = np.random.RandomState(1).randn(40, 5) + 2
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "doc_id long, v array<double>")
    model = feat.fit_pca(df, "v", 5)
    reduced = model.transform(df.select("doc_id", array_to_vector("v").alias("_raw"))).orderBy("doc_id").collect()
    centred = m - m.mean(axis=0)
    np.testing.assert_allclose([r._reduced.dot(r._reduced) for r in reduced], (centred**2).sum(axis=1))


@pytest.mark.parametrize(("block", "spread"), [(20, 0.05), (20, 5.0), (1000, 0.05)])
def test_pruned_nearest_equals_the_full_product(spark, block, spread):
    """Tight groups let most pairs of blocks be skipped, loose ones few; the result is the same."""
    rng = np.random.RandomState(7)
    m = np.concatenate([rng.randn(12) * 3 + rng.randn(25, 12) * spread for _ in range(6)]).astype(np.float32)
    m[3] = 0
    table = spark.createDataFrame([(2 * i, [float(x) for x in v]) for i, v in enumerate(m)], "id int, vec array<float>")
    full = {r.id: r.sims for r in emb.nearest_similarities(table, 5).collect()}
    found, skipped, total = emb.pruned_similarities(table, 5, block)
    got = {r.id: r.sims for r in found.collect()}
    assert sorted(got) == sorted(full)
    for i in full:
        np.testing.assert_allclose(got[i], full[i], atol=1e-9)
    if block < 1000 and spread < 1:
        assert skipped > total / 4
