from lexiframe.operators.dataset import limit_samples
from lexiframe.session import recorded_copies

N = 12_000


def test_only_the_first_documents_are_put_in_order(spark):
    pairs = [(None if d == 0 else d, p) for d in range(40) for p in range(700)]
    rows = spark.createDataFrame(pairs, "doc_id long, pos int").repartition(4, "pos")
    with recorded_copies() as made:
        taken = [(r["doc_id"], r["pos"]) for r in limit_samples(rows, N, shuffle=False).collect()]
    assert sorted(taken, key=str) == sorted(pairs[:N], key=str)
    ranked = [path for path in made if "/ranked-" in path]
    assert spark.read.parquet(ranked[0]).count() < N + 700
    assert limit_samples(rows.limit(N - 1), N, shuffle=False).count() == N - 1
