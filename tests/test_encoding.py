import pytest
from pyspark.sql import functions as F

from lexiframe.functions.ids import left_pad_context, pad_ids, truncate_ids
from lexiframe.operators.encoding import decode, encode
from lexiframe.operators.lookup import lookup, split_head


@pytest.fixture
def vocab(spark):
    tokens = ["<PAD>", "<UNK>", "<BOS>", "<EOS>", "a", "heron", "slept", "under", "log", "frog"]
    return spark.createDataFrame(list(enumerate(tokens)), "id int, token string")


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def ids(df):
    return {r.doc_id: r.ids for r in df.collect()}


def test_encode(spark, vocab):
    df = frame(spark, "A heron jumped", "", "... !", "frog frog")
    assert ids(encode(df, vocab)) == {0: [4, 5, 1], 1: [], 2: [], 3: [9, 9]}
    assert ids(encode(df, vocab, add_bos_eos=True)) == {0: [2, 4, 5, 1, 3], 1: [2, 3], 2: [2, 3], 3: [2, 9, 9, 3]}


def test_truncation_keeps_eos_only_with_markers(spark, vocab):
    df = frame(spark, "a heron slept under")
    assert ids(encode(df, vocab, max_length=2)) == {0: [4, 5]}
    assert ids(encode(df, vocab, add_bos_eos=True, max_length=4)) == {0: [2, 4, 5, 3]}
    assert ids(encode(df, vocab, add_bos_eos=True, max_length=1)) == {0: [3]}
    with pytest.raises(ValueError):
        truncate_ids(F.col("ids"), 0)


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1, 2],), ([],)], "ids array<int>")
    right = [r[0] for r in df.select(pad_ids(F.col("ids"), 3)).collect()]
    assert right == [[1, 2, 3], [1, 2, 0], [0, 0, 0]]
    left = [r[0] for r in df.select(left_pad_context(F.col("ids"), 4)).collect()]
    assert left == [[2, 3, 4, 5], [0, 0, 1, 2], [0, 0, 0, 0]]


def test_decode(spark, vocab):
    df = spark.createDataFrame([(0, [2, 4, 5, 99, -1, 1, 3]), (1, []), (2, [0, 3])], "doc_id long, ids array<int>")
    skipped = {r.doc_id: r.text for r in decode(df, vocab).collect()}
    assert skipped == {0: "a heron", 1: "", 2: ""}
    full = {r.doc_id: r.text for r in decode(df, vocab, skip_special=False).collect()}
    assert full == {0: "<BOS> a heron <UNK> <UNK> <UNK> <EOS>", 1: "", 2: "<PAD> <EOS>"}


def test_round_trip(spark, vocab):
    texts = ["a heron slept under a log", "frog", "log log"]
    back = decode(encode(frame(spark, *texts), vocab, add_bos_eos=True), vocab)
    assert [r.text for r in back.orderBy("doc_id").collect()] == texts


def test_only_the_text_is_shuffled(spark, vocab):
    """One exchange of documents; exploded tokens stay where they are."""
    df = frame(spark, "a heron", "frog")
    plan = encode(df, vocab.limit(10))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan


def test_large_vocabulary_is_joined_by_shuffle(spark, vocab):
    """Whatever part of the vocabulary is broadcast, IDs and texts are the same."""
    df = frame(spark, *["a heron slept under a log " * 20] * 5, "", "frog unknown", "unknown", "log")
    small, text = ids(encode(df, vocab)), decode(encode(df, vocab), vocab).collect()
    full = decode(encode(df, vocab), vocab, skip_special=False).collect()
    for head_bytes in (0, 90, 300):
        large = encode(df, vocab, head_bytes=head_bytes)
        assert ids(large) == small
        assert sorted(decode(large, vocab, head_bytes=head_bytes).collect()) == sorted(text)
        assert sorted(decode(large, vocab, skip_special=False, head_bytes=head_bytes).collect()) == sorted(full)


def test_lookup_with_heads_of_any_size(spark):
    rows = spark.createDataFrame([(i, f"k{i % 9}") for i in range(60)] + [(99, None)], "n int, key string")
    table = spark.createDataFrame([(f"k{i}", i, float(i)) for i in range(7)], "key string, place int, v double")
    expected = sorted((n, None if k is None or int(k[1]) > 6 else float(k[1])) for n, k in rows.collect())
    for head_bytes in (0, 100, 200, 10**6):
        found = lookup(rows, table, "key", "place", head_bytes, salts=3)
        assert sorted((r.n, r.v) for r in found.collect()) == expected
    head, tail = split_head(table, "place", 120)
    assert head.count() + tail.count() == 7 and 0 < head.count() < 7


@pytest.mark.parametrize("hot", ["known", "unknown"])
def test_no_task_holds_the_rows_of_a_hot_key(spark, hot):
    """Half of all rows ask for one key, once one of the head and once one the table lacks; nothing is broadcast unasked."""
    key = "w0" if hot == "known" else "lacking"
    rows = spark.range(8000, numPartitions=8).selectExpr("id AS n", f"if(id % 2 = 0, '{key}', concat('w', id % 500)) AS key")
    table = spark.range(500).selectExpr("concat('w', id) AS key", "int(id) AS place", "int(id) AS v")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for k, value in zip(old, ("-1", "16", "false")):
        spark.conf.set(k, value)
    try:
        found = lookup(rows, table, "key", "place", head_bytes=2000)
        shares = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in shares) == 8000 and max(r["count"] for r in shares) < 1600
        assert found.where(f"key = '{key}' AND v IS {'NULL' if hot == 'known' else 'NOT NULL'}").isEmpty()
    finally:
        for k, value in old.items():
            spark.conf.set(k, value)
