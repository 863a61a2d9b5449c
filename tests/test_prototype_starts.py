"""The query over prototypes fits them with the operator's own number of starts."""

import os

import pytest

from lexiframe.operators import features
from lexiframe.registry import queries
from lexiframe.session import recorded_copies

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_prototype_similarity_takes_all_starts(spark, monkeypatch):
    seeds, kmeans = [], features.KMeans

    def counted(**options):
        seeds.append(options["seed"])
        return kmeans(**options)

    monkeypatch.setattr(features, "KMeans", counted)
    assert not queries.QUERIES["prototype_similarity"](spark, SF).isEmpty()
    assert seeds == [features.KMEANS_SEED + i for i in range(10)] and features.KMEANS_INITS == 10


def test_passes_over_a_large_table_are_shared_by_tasks(spark, monkeypatch):
    seen, kmeans = [], features.KMeans

    class Counted:
        def __init__(self, **options):
            self.inner = kmeans(**options)

        def fit(self, data):
            seen.append(max(data.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()))
            return self.inner.fit(data)

    monkeypatch.setattr(features, "KMeans", Counted)
    table = spark.range(0, 40, 1, 1).selectExpr("int(id) AS id", "array(float(id % 5), float(id % 3)) AS vec")
    features.fit_prototypes(table, 3, n_init=1)
    monkeypatch.setattr(features, "KMEANS_ROWS", 20)
    centres = features.fit_prototypes(table, 3, n_init=1)
    # Splits without rows are no help.
    empty = table.where("id < 0")
    features.fit_prototypes(table.union(empty).union(empty).union(empty), 3, n_init=1)
    assert seen == [40, 20, 20] and centres.shape == (3, 2)


@pytest.mark.parametrize("name", ["mean_pool", "given_prototypes"])
def test_over_a_large_table_texts_are_encoded_once(spark, monkeypatch, name):
    for limit, copies in ((features.MATRIX_BYTES, 0), (1000, 1)):
        monkeypatch.setattr(features, "MATRIX_BYTES", limit)
        with recorded_copies() as made:
            queries.QUERIES[name](spark, SF)
        assert sum("/encoded-" in path for path in made) == copies
