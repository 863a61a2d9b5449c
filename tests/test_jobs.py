from lexiframe.operators import generation, next_token
from lexiframe.plans import jobs
from lexiframe.sources import artifacts

SENTENCES = [
    "Rain fell on seven quiet hills.",
    "Seven boats left before noon, and rain fell.",
    "Quiet boats drift home.",
]


def test_corpus_to_generated_text(spark, tmp_path):
    (tmp_path / "corpus.txt").write_text("\n".join(SENTENCES * 6))
    docs = jobs.load_corpus(spark, str(tmp_path / "corpus.txt"))
    assert docs.count() == 18

    vocab = jobs.build_vocabulary(docs, str(tmp_path / "tok"), min_freq=1, top_k=20)
    assert vocab.count() == 4 + 13
    stats = spark.read.json(str(tmp_path / "tok" / "stats")).first()
    assert (stats.n_documents, stats.vocab_size, stats.oov_tokens) == (18, 13, 0)
    covered = jobs.build_vocabulary(docs, str(tmp_path / "cov"), coverage_percent=50.0)
    assert 4 < covered.count() < 17

    rows = jobs.make_dataset(docs, str(tmp_path / "tok"), str(tmp_path / "data"), 4, max_samples=100, val_ratio=0.1)
    assert rows.count() == 100
    assert artifacts.read_dataset(spark, str(tmp_path / "data"), "val").count() == 10
    assert spark.read.json(str(tmp_path / "data" / "stats")).first().n_documents == 18

    model, report = jobs.train_model(rows, vocab, str(tmp_path / "run"))
    assert {r.split: r.num_classes for r in report.collect()} == {"train": 17, "val": 17} and model.order == 2

    (tmp_path / "prompts.txt").write_text("quiet boats\n\nrain fell\n")
    scorer = generation.model_scorer(next_token.load_model(spark, str(tmp_path / "run" / "model")))
    texts = jobs.generate_texts(
        spark, str(tmp_path / "prompts.txt"), vocab, scorer, 4, str(tmp_path / "out"), max_new_tokens=1, sampling="greedy"
    )
    assert sorted(r.generated[:6] for r in texts.collect()) == ["quiet ", "rain f"]
    assert spark.read.json(str(tmp_path / "out")).count() == 2
