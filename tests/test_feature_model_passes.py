"""A feature model reads the rows it is fit on once, whatever it learns from them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexiframe.operators import features as feat
from lexiframe.operators.dataset import context_windows
from lexiframe.operators.feature_model import ContextFeatures

DIM = 5


def test_a_feature_model_reads_its_rows_once(spark):
    vecs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.random.RandomState(1).randn(9, DIM))], "id int, vec array<float>")
    encoded = spark.createDataFrame([(d, [2, *range(4, 4 + d % 5), 3]) for d in range(12)], "doc_id long, ids array<int>")
    seen = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<int>")
    def same(values: pa.Array) -> pa.Array:
        seen.add(len(values))
        return values

    rows = context_windows(encoded, 4)
    n = rows.count()
    counted = rows.withColumn("ctx", same.asNondeterministic()("ctx"))
    options = feat.FeatureOptions(mean_pooled=True, max_pooled=True, reduce_to=2)
    model = ContextFeatures(options, vecs).fit(counted)
    assert seen.value == n and model.length == 4
    for kind in ("mean", "max"):
        alone = feat.fit_pca(feat.pool_embeddings(rows, vecs, (kind,)), f"{kind}_pooled", 2)
        np.testing.assert_allclose(model.pca[kind].stages[1].pc.toArray(), alone.stages[1].pc.toArray(), atol=1e-9)
