"""Words are looked up and counted in tasks; rows, nulls and repeated keys come out as by joins."""

from pyspark.sql import functions as F

from lexiframe.functions.text import tokenize
from lexiframe.operators.encoding import encode
from lexiframe.operators.next_token import count_targets, fit_next_token_model, model_report
from lexiframe.operators.vocabulary import count_vocab

TEXTS = [(1, "A heron's Kite, İce café 42"), (2, None), (3, ""), (4, "frog frog heron"), (4, "pond"), (None, "pond frog")]


def test_encoded_in_tasks_as_by_joins(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    vocab = spark.createDataFrame([(4, "frog"), (5, "pond"), (6, "kite"), (7, "i"), (8, "caf"), (9, "heron's")], "id int, token string")
    plan = encode(docs, vocab, in_tasks=True)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Generate" not in plan
    for lowercase in (True, False):
        quick = encode(docs, vocab, add_bos_eos=True, lowercase=lowercase, in_tasks=True)
        joined = encode(docs, vocab, add_bos_eos=True, lowercase=lowercase)
        assert sorted(map(str, quick.collect())) == sorted(map(str, joined.collect()))


def test_counted_in_tasks_as_by_rows(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert "MapInArrow" in count_vocab(docs)._jdf.queryExecution().executedPlan().toString()
    for lowercase in (True, False):
        quick = count_vocab(docs, lowercase=lowercase)
        by_rows = count_vocab(docs, tokenizer=lambda t: tokenize(t, lowercase))
        assert sorted(quick.collect()) == sorted(by_rows.collect())


def test_counted_pairs_give_the_model_of_their_rows(spark):
    seen = [([0, 2], 5, "train"), ([2, 5], 6, "train"), ([2, 5], 6, "val"), ([2, 5], 7, "train"), ([5, 6], 3, "val"), ([9, 5], 6, "train")]
    rows = spark.createDataFrame(seen, "ctx array<int>, y int, split string")
    pairs = count_targets(rows, by=("split",))
    one = fit_next_token_model(rows.where("split = 'train'"))
    two = fit_next_token_model(pairs.where("split = 'train'"), counted=True)
    assert sorted(map(str, one.table.collect())) == sorted(map(str, two.table.collect()))
    assert sorted(map(str, one.heads.collect())) == sorted(map(str, two.heads.collect()))
    assert one.heads.where(F.size("ctx") == 2).where("ctx[0] = 2").first()["best"] == 6
    a, b = model_report(rows, one, 12).collect(), model_report(pairs, two, 12, counted=True).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
