import json
import re

import pytest

from lexiframe.operators.vocabulary import assign_ids, count_vocab
from lexiframe.sources import artifacts, corpus, word_vectors

THREE_LINES = [
    "This is a test document.",
    "This is another test document with more words.",
    "A third document for testing purposes.",
]


def texts(df, order="doc_id"):
    return [r.text for r in df.orderBy(order).collect()]


def write(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_paragraphs_equal_python(spark, tmp_path):
    content = "\n\nfirst paragraph\nits second line\n \t\nsecond paragraph\n\n\n\n  third paragraph  \nshort\n\nshort\n\nexactly 10\n\nexactly 11c\n"
    path = write(tmp_path / "a.txt", content)
    expected = [p.strip() for p in re.split(r"\n\s*\n+", content) if len(p.strip()) > 10]
    docs = corpus.read_paragraphs(spark, path)
    assert texts(docs) == expected
    assert [r.doc_id for r in docs.orderBy("doc_id").collect()] == list(range(len(expected)))


def test_paragraphs_with_crlf_and_bad_bytes(spark, tmp_path):
    content = b"first paragraph\r\nline two\r\n\r\nsecond \xff\xfeparagraph\r\n  \r\nthird paragraph"
    path = write(tmp_path / "a.txt", content)
    expected = ["first paragraph\nline two", "second paragraph", "third paragraph"]
    assert texts(corpus.read_paragraphs(spark, path)) == expected
    assert texts(corpus.read_paragraphs(spark, path, line_sep="\r\n\r\n")) == expected


def test_numbering_over_many_splits(spark, tmp_path):
    expected = []
    for f in range(3):
        paragraphs = [f"paragraph {f}-{i} with some words" for i in range(400)]
        write(tmp_path / f"{f}.txt", "\n\n".join(paragraphs))
        expected += paragraphs
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        docs = corpus.read_paragraphs(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() > 3
        assert texts(docs) == expected
        assert texts(corpus.limit_docs(docs, 450)) == expected[:450]
        lines = corpus.read_lines(spark, str(tmp_path), max_lines=101).orderBy("file", "line_no").collect()
        assert [r.text for r in lines] == [f"paragraph {f}-{i} with some words" for f in range(3) for i in range(51)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fallback_to_lines_with_limit(spark, tmp_path):
    path = write(tmp_path / "three.txt", "\n".join(THREE_LINES))
    assert texts(corpus.read_corpus(spark, path)) == THREE_LINES
    assert texts(corpus.read_corpus(spark, path, max_docs=2)) == THREE_LINES[:2]


def test_fallback_is_decided_per_file(spark, tmp_path):
    write(tmp_path / "few.txt", "one paragraph here\nwith two lines\n\nanother one here")
    many = [f"paragraph number {i}\nsecond line" for i in range(10)]
    write(tmp_path / "many.txt", "\n\n".join(many))
    got = texts(corpus.read_paragraphs_or_lines(spark, str(tmp_path)))
    assert got == ["one paragraph here", "with two lines", "another one here", *many]


def test_lines_keep_ten_characters_paragraphs_do_not(spark, tmp_path):
    path = write(tmp_path / "a.txt", "0123456789\n\n012345678\n  01234567890 \n")
    assert [r.text for r in corpus.read_lines(spark, path).orderBy("line_no").collect()] == ["0123456789", "01234567890"]
    assert texts(corpus.read_paragraphs_or_lines(spark, path)) == ["01234567890"]


def test_no_document_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no document"):
        corpus.read_corpus(spark, write(tmp_path / "a.txt", "short\n\ntiny"))


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,text\n1,"two\nlines, ""quoted"""\n2,\n3,NA\n4,007\n5,short\n')
    assert texts(corpus.read_corpus(spark, path, is_csv=True)) == ['two\nlines, "quoted"', "007", "short"]
    with pytest.raises(ValueError, match="no column"):
        corpus.read_csv_texts(spark, path, "body")
    with pytest.raises(ValueError, match="no header"):
        corpus.read_csv_texts(spark, write(tmp_path / "empty.csv", ""))


def test_corpus_profile(spark):
    df = spark.createDataFrame([(0, "abcd"), (1, "ab"), (2, "éé")], "doc_id long, text string")
    assert tuple(corpus.corpus_profile(df).first()) == (3, 3.0, 2, 4)


def test_word_vectors(spark, tmp_path):
    path = write(tmp_path / "v.txt", "the 1 0 0\ncat 0 1 0\nbad 1 x 0\nlone\ntwo 1\nthe 0 0 2\n")
    read = {r.token: r.vec for r in word_vectors.read_text_embeddings(spark, path).collect()}
    assert read == {"the": [0.0, 0.0, 2.0], "cat": [0.0, 1.0, 0.0]}
    first = {r.token: r.vec for r in word_vectors.read_text_embeddings(spark, path, max_vocab=1).collect()}
    assert first == {"the": [1.0, 0.0, 0.0]}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        word_vectors.read_text_embeddings(spark, path, skip_invalid=False).collect()
    with pytest.raises(ValueError, match="components"):
        word_vectors.read_text_embeddings(spark, path, dim=4)


def test_vocab_and_tokenizer_round_trip(spark, docs, tmp_path):
    vocab = assign_ids(count_vocab(docs), 1, None)
    expected = sorted((r.id, r.token, r["count"]) for r in vocab.collect())
    options = artifacts.TokenizerOptions(lowercase=False)
    artifacts.write_tokenizer(vocab, str(tmp_path / "t"), options)
    read, stored = artifacts.read_tokenizer(spark, str(tmp_path / "t"))
    assert sorted((r.id, r.token, r["count"]) for r in read.collect()) == expected
    assert stored == options
    with pytest.raises(ValueError, match="dense"):
        artifacts.check_vocab(vocab.where("id <> 5"))


def test_import_vocab_json(spark, tmp_path):
    record = {"tokens": ["the", "cat"], "size": 2, "frequencies": {"the": 5, "cat": 2}}
    for content, counts in ((record, [5, 2]), (["the", "cat"], [None, None])):
        path = write(tmp_path / "v.json", json.dumps(content))
        rows = artifacts.import_vocab_json(spark, path).where("id >= 4").orderBy("id").collect()
        assert [(r.id, r.token) for r in rows] == [(4, "the"), (5, "cat")]
        assert [r["count"] for r in rows] == counts
    with pytest.raises(ValueError, match="neither"):
        artifacts.import_vocab_json(spark, write(tmp_path / "v.json", "3"))


def test_dataset_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, 1, [0, 2], 4, "train"), (0, 2, [2, 4], 3, "val"), (1, 1, [0, 2], 3, "train")],
        "doc_id long, pos int, ctx array<int>, y int, split string",
    )
    artifacts.write_dataset(rows, str(tmp_path / "d"))
    assert artifacts.read_dataset(spark, str(tmp_path / "d")).count() == 3
    assert artifacts.read_dataset(spark, str(tmp_path / "d"), "val").select("y").collect()[0].y == 3
    meta = spark.read.json(str(tmp_path / "d" / "metadata")).first()
    assert (meta.n_samples, meta.context_length, meta.n_unique_targets) == (3, 2, 2)


def test_prompts_and_generations(spark, tmp_path):
    path = write(tmp_path / "p.txt", "  Once upon \n\nThe end\n")
    prompts = artifacts.read_prompts(spark, path).orderBy("prompt_id").collect()
    assert [(r.prompt_id, r.prompt) for r in prompts] == [(0, "Once upon"), (2, "The end")]
    generations = spark.createDataFrame([("a", 0, "a b")], "prompt string, sample_idx int, generated string")
    artifacts.write_generations(generations, str(tmp_path / "json"), sampling="greedy")
    stored = spark.read.json(str(tmp_path / "json")).first()
    assert (stored.prompt, stored.generated, stored.sampling) == ("a", "a b", "greedy")
    artifacts.write_generations(generations, str(tmp_path / "text"), as_text=True)
    assert "Generated: a b" in [r.value for r in spark.read.text(str(tmp_path / "text")).collect()]
