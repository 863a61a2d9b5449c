from lexiframe.operators.dataset import context_windows, n_unique
from lexiframe.operators.splitting import train_val_split
from lexiframe.sources.artifacts import read_dataset, write_dataset


def test_contexts_of_any_kind_are_counted_once(spark):
    ctxs = [None, None, [], [], [1], [1], [1, 2], [2, 3], [2, 3], [None, 2], [None, 2], [0, 2], [1, 2, 3, 4, 5], [2, 3, 4, 5, 6]]
    ctxs += [[2, 3, 4, 5, 6], [3, 4, 5, 6, 2], [-1, 0, 0, 0, 0], [9, 9, 9, 9, 9], [9, 9, 9, 9, 9]]
    rows = spark.createDataFrame([(c, 1) for c in ctxs], "ctx array<int>, y int")
    found = n_unique(rows).first()
    assert found["n_unique_contexts"] == len({None if c is None else tuple(c) for c in ctxs})
    assert n_unique(rows.where("false")).first().asDict() == {"n_unique_contexts": 0, "n_unique_targets": 0}


def test_windows_are_counted_once_and_travel_together(spark):
    docs = [(d, [2, *[(d % 5 * i * i + i) % 23 + 4 for i in range(40 + 30 * (d % 3))], 3]) for d in range(60)]
    rows = context_windows(spark.createDataFrame(docs, "doc_id long, ids array<int>").repartition(3), 16)
    found = n_unique(rows)
    assert found.first()["n_unique_contexts"] == rows.select("ctx").distinct().count()
    keys = [part.split(")")[0] for part in found._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(")[1:]]
    assert keys and not [key for key in keys if "ctx" in key]


def test_a_dataset_is_written_without_sorting_by_split(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(d, [2, *range(4, 30), 3]) for d in range(20)], "doc_id long, ids array<int>")
    rows, seen = train_val_split(context_windows(docs, 4)), []
    key = "spark.sql.maxConcurrentOutputFileWriters"
    from pyspark.sql import DataFrameWriter

    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(int(spark.conf.get(key))), plain(self, *a, **k))[1])
    before = spark.conf.get(key)
    write_dataset(rows, str(tmp_path))
    assert max(seen) >= 2 and spark.conf.get(key) == before
    back = read_dataset(spark, str(tmp_path))
    assert back.count() == rows.count() and {r["split"] for r in back.select("split").distinct().collect()} == {"train", "val"}
