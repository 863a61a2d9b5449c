import math

import pytest
from pyspark.sql import functions as F

from lexiframe.functions.hashing import hash_key
from lexiframe.operators import dataset, ranking, splitting


def encoded(spark, *lists):
    return spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")


def loop_windows(ids, length):
    return [([0] * length + ids)[i : i + length] for i in range(1, len(ids))], ids[1:]


@pytest.mark.parametrize("length", [1, 3, 4, 16])
def test_windows_equal_loop(spark, length):
    lists = [[2, 10, 11, 3], [2, 3], [2, *range(4, 60), 3], [2]]
    rows = dataset.context_windows(encoded(spark, *lists), length).orderBy("doc_id", "pos").collect()
    expected = []
    for d, ids in enumerate(lists):
        for pos, (ctx, y) in enumerate(zip(*loop_windows(ids, length)), 1):
            expected.append((d, pos, ctx, y))
    assert [(r.doc_id, r.pos, r.ctx, r.y) for r in rows] == expected


def test_window_plan_is_narrow_and_pruned(spark):
    rows = dataset.context_windows(encoded(spark, [2, 4, 3]), 16)
    plan = rows.select("y")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "slice" not in plan


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(700).select(F.col("id").alias("doc_id"))
    rows = base.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("pos"))
    # One class holds a third of the rows, another a single one.
    y = F.when(F.col("doc_id") % 3 == 0, 1).otherwise((F.col("doc_id") % 40 + 4).cast("int"))
    return rows.select("doc_id", "pos", F.array(F.lit(0), F.lit(2)).alias("ctx"), y.cast("int").alias("y")).cache()


def keys(df):
    return sorted((r.doc_id, r.pos) for r in df.select("doc_id", "pos").collect())


def hash_order(rows, seed):
    return [(r.doc_id, r.pos) for r in rows.orderBy(hash_key(seed, "doc_id", "pos")).collect()]


def test_rank_without_single_task(rows):
    ranked = ranking.number_in_order(rows, [F.desc("pos"), F.asc("doc_id")], "rank").collect()
    expected = sorted(((r.doc_id, r.pos) for r in ranked), key=lambda k: (-k[1], k[0]))
    assert [(r.doc_id, r.pos) for r in sorted(ranked, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in ranked) == list(range(1, 3501))


def test_take_first_both_ways(rows, monkeypatch):
    order = [F.asc("doc_id"), F.asc("pos")]
    few = keys(ranking.take_first(rows, order, 123))
    monkeypatch.setattr(ranking, "SMALL_LIMIT", 10)
    assert keys(ranking.take_first(rows, order, 123)) == few == keys(rows)[:123]


@pytest.mark.parametrize("n", [1, 2, 100, 3499, 3500, 9999])
def test_limit_samples_both_ways(rows, monkeypatch, n):
    expected = sorted(hash_order(rows, 42)[:n])
    assert keys(dataset.limit_samples(rows, n)) == expected
    monkeypatch.setattr(ranking, "SMALL_LIMIT", 0)
    assert keys(dataset.limit_samples(rows, n)) == expected
    monkeypatch.setattr(ranking, "SMALL_BUCKET", 2)
    assert keys(dataset.limit_samples(rows, n)) == expected


def test_cutoff_of_uneven_keys(spark):
    """Keys that are not spread evenly miss the band and are found by prefix."""
    near = spark.range(1000).select(F.concat(F.lit("0" * 20), F.lpad(F.hex("id"), 12, "0")).alias("k"))
    ordered = sorted(r.k for r in near.collect())
    assert ranking.key_cutoff(near, "k", 500) == ordered[499]
    assert ranking.key_cutoff(near, "k", 1000) is None


def test_shuffle(rows):
    shuffled = [(r.doc_id, r.pos) for r in dataset.shuffle_rows(rows).collect()]
    assert shuffled == hash_order(rows, 42) and shuffled != sorted(shuffled)
    placed = dataset.shuffle_rows(rows, place="place").collect()
    assert [(r.doc_id, r.pos) for r in sorted(placed, key=lambda r: r.place)] == shuffled


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.333, 1.0])
def test_split_is_exact_disjoint_complete(rows, ratio):
    split = splitting.train_val_split(rows, ratio, seed=7)
    parts = {s: keys(split.where(F.col("split") == s)) for s in ("train", "val")}
    n_val = int(3500 * ratio)
    assert len(parts["val"]) == n_val
    assert sorted(parts["train"] + parts["val"]) == keys(rows)
    assert parts["val"] == sorted(hash_order(rows, 7)[3500 - n_val :])


def test_ordered_split(rows):
    split = splitting.ordered_split(rows, 0.101)
    assert keys(split.where("split = 'val'")) == keys(rows)[3500 - math.ceil(353.5) :]


def largest_remainder(sizes, n_train):
    total = sum(sizes.values())
    base = {y: n * n_train // total for y, n in sizes.items()}
    order = sorted(sizes, key=lambda y: (-(sizes[y] * n_train % total), y))
    for y in order[: n_train - sum(base.values())]:
        base[y] += 1
    return base


@pytest.mark.parametrize("bucket, block", [(100_000, 1 << 16), (3, 1 << 16), (3, 8)])
def test_stratified_split(rows, monkeypatch, bucket, block):
    monkeypatch.setattr(splitting, "SMALL_BUCKET", bucket)
    monkeypatch.setattr(splitting, "BLOCK", block)
    split = splitting.stratified_split(rows, 0.1, seed=5)
    assert split.count() == 3500 and keys(split) == keys(rows)
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    quota = largest_remainder(sizes, 3500 - 350)
    train = split.where("split = 'train'")
    assert {r.y: r["count"] for r in train.groupBy("y").count().collect()} == quota
    hot = [k for k in hash_order(rows.where("y = 1"), 5)]
    assert keys(train.where("y = 1")) == sorted(hot[: quota[1]])


def test_stratified_split_falls_back(spark, rows):
    lone = spark.createDataFrame([(9999, 1, [0, 2], 77)], "doc_id long, pos int, ctx array<int>, y int")
    split = splitting.stratified_split(rows.unionByName(lone), 0.1)
    assert split.where("split = 'val'").count() == math.ceil(350.1)
    unshuffled = splitting.stratified_split(rows, 0.1, shuffle=False)
    assert keys(unshuffled.where("split = 'val'")) == keys(rows)[3150:]


def test_profile_and_columns(spark):
    vocab = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id int, token string")
    rows = dataset.context_windows(encoded(spark, [2, 4, 1, 3], [2, 4, 3]), 2)
    row = dataset.dataset_profile(rows, vocab).first()
    assert (row.n_samples, row.context_length, row.vocab_size) == (5, 2, 6)
    assert (row.n_unique_contexts, row.n_unique_targets) == (3, 3)
    assert (row.padding_ratio, row.unk_ratio_x, row.unk_ratio_y) == (0.2, 0.1, 0.2)
    assert [tuple(t) for t in row.top_targets] == [(3, "t3", 2, 0.4), (4, "t4", 2, 0.4), (1, "t1", 1, 0.2)]
    top = dataset.top_targets(rows, vocab, 2).collect()
    assert [(r.y, r.token, r["count"], r.frequency) for r in top] == [(3, "t3", 2, 0.4), (4, "t4", 2, 0.4)]
    named = dataset.top_targets(rows, vocab.where("id <> 3"), 1).first()
    assert named.token == "ID_3"
    wide = dataset.feature_columns(rows, 2)
    assert wide.columns == ["doc_id", "pos", "y", "token_t-2", "token_t-1"]
    meta = dataset.dataset_metadata(rows).first()
    assert (meta.n_samples, meta.context_length, meta.n_unique_targets, meta.ctx_type) == (5, 2, 3, "array<int>")
    stats = dataset.dataset_stats(rows, vocab, encoded(spark, [2], [3]), seed=42).first()
    assert (stats.n_documents, stats.seed) == (2, 42)


def test_take_by_key_is_exact_with_equal_keys(spark):
    from lexiframe.functions.hashing import hash_key
    from lexiframe.operators.ranking import take_by_key

    df = spark.range(30_000).select((F.col("id") % 100).alias("k"))
    for n in (9_999, 10_050):
        assert take_by_key(df, hash_key(1, "k"), n).count() == n
