import re

import pytest
from pyspark.sql import functions as F

from lexiframe.functions.text import chunk_starts, strip, tokenize, unify_newlines
from lexiframe.sources.corpus import chunk_docs

TEXTS = [
    "", "   ", "Hello, World!", "don't  stop'", "café naïve über", "a1-b2_c3", "'", "ÅNGSTRÖM İstanbul Kelvin",
    "tab\tnew\nline\r\nend", "日本語 text 中文", "MixED CaSe X", "x" * 3000,
]


def reference_tokens(text, lowercase=True):
    return re.sub("[^a-z0-9']+", " ", text.lower() if lowercase else text).split()


@pytest.mark.parametrize("lowercase", [True, False])
def test_tokenize_equals_python(spark, lowercase):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", tokenize(F.col("t"), lowercase).alias("w")).collect()}
    assert got == {i: reference_tokens(t, lowercase) for i, t in enumerate(TEXTS)}


def test_strip_equals_python(spark):
    texts = ["  a b ", " x ", "\x1cy\x1f\x85", "\n\t", "", "z​ "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(strip(F.col("t")).alias("s")).collect()] == [t.strip() for t in texts]


def test_unify_newlines(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n",)], "t string")
    assert df.select(unify_newlines(F.col("t")).alias("s")).first().s == "a\nb\nc\n"


def loop_starts(n, size, overlap):
    if n <= size:
        return [0]
    out, start = [], 0
    while True:
        out.append(start)
        start += size - overlap
        if n - start < overlap or start >= n:
            return out


@pytest.mark.parametrize("size,overlap", [(10, 3), (10, 0), (7, 6), (1000, 100)])
def test_chunk_starts_equal_loop(spark, size, overlap):
    lengths = list(range(0, 60)) + [999, 1000, 1001, 1899, 1900, 2500]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    got = {r.n: r.s for r in df.select("n", chunk_starts(F.col("n"), size, overlap).alias("s")).collect()}
    assert got == {n: loop_starts(n, size, overlap) for n in lengths}


def test_chunk_docs_counts_characters(spark):
    df = spark.createDataFrame([(0, "é" * 25)], "doc_id long, text string")
    chunks = chunk_docs(df, 10, 3).orderBy("chunk").collect()
    assert [(c.start, c.text) for c in chunks] == [(0, "é" * 10), (7, "é" * 10), (14, "é" * 10), (21, "é" * 4)]


def test_chunk_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunk_starts(F.lit(5), 10, 10)
