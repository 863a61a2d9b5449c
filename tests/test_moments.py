"""A PCA is fit in one pass over the rows, from moments that workers make of batches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lexiframe.functions.moments import merged, moments, points_of
from lexiframe.operators import features as feat

DIM = 5


def _matrix(n=90):
    # Far from zero, so that plain sums of squares would lose digits.
    return np.random.RandomState(2).randn(n, DIM) @ np.diag([4, 3, 2, 1, 0.5]) + 1e5


def _counted(spark, column, seen):
    """The column by way of a Python function that counts its rows."""

    @F.arrow_udf("array<double>")
    def same(values: pa.Array) -> pa.Array:
        seen.add(len(values))
        return values

    return same(column)


def test_moments_of_parts_are_those_of_the_whole():
    m = _matrix()
    one = merged(moments(m[a:b]) for a, b in ((0, 1), (1, 40), (40, 90)))
    assert one.n == 90 and merged([]) is None
    np.testing.assert_allclose(one.mean, m.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(one.scatter / 89, np.cov(m.T), rtol=1e-8, atol=1e-8)
    points = points_of(one)
    np.testing.assert_allclose(points.mean(axis=0), m.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(np.cov(points.T), np.cov(m.T), rtol=1e-7, atol=1e-7)
    with pytest.raises(ValueError, match="differ in length"):
        merged([one, moments(m[:, :2])])


def test_a_pca_reads_the_rows_once_and_equals_that_of_all_rows(spark):
    m, seen = _matrix(), spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "doc_id long, v array<double>").repartition(3)
    model = feat.fit_pca(df.select(_counted(spark, F.col("v"), seen).alias("v")), "v", 3)
    assert seen.value == len(m)
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred")
    whole = Pipeline(stages=[centre, PCA(k=3, inputCol="_centred", outputCol="_reduced")])
    whole = whole.fit(df.select(array_to_vector("v").alias("_raw")))
    np.testing.assert_allclose(model.stages[0].mean.toArray(), whole.stages[0].mean.toArray())
    np.testing.assert_allclose(model.stages[1].pc.toArray(), whole.stages[1].pc.toArray(), atol=1e-7)
    one = {r.doc_id: r.v for r in feat.project(df, "v", model).collect()}
    two = whole.transform(df.select("doc_id", array_to_vector("v").alias("_raw"))).collect()
    np.testing.assert_allclose([one[r.doc_id] for r in two], [r["_reduced"].toArray() for r in two], atol=1e-6)


def test_rows_a_pca_cannot_use_are_errors(spark):
    for values, words in (("cast(null AS array<double>)", "is null"), ("array(1D, null)", "has a null"), ("array(1D, 2D, 3D)", "length")):
        rows = spark.sql(f"SELECT explode(array(array(1D, 2D), array(3D, 1D), {values})) AS v").coalesce(1)
        with pytest.raises(Exception, match=words):
            feat.fit_pca(rows, "v", 1)
    for n, words in ((0, "one row"), (1, "two rows")):
        with pytest.raises(ValueError, match=words):
            feat.fit_pca(spark.range(n).selectExpr("array(1D, 2D) AS v"), "v", 1)
