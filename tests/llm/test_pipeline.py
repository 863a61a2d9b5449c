"""The stages of the pipeline on small inputs."""

import random

import corpus_pipeline
from lexiframe.session import let_workers_import

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(words, places):
    return [f"{w}x" if i in places else w for i, w in enumerate(words)]


def shingle_sets(text, k=5):
    w = (text or "").split()
    return {tuple(w[a : a + k]) for a in range(max(len(w) - k + 1, 1))} if w else set()


def similarity(a, b, k=5):
    a, b = shingle_sets(a, k), shingle_sets(b, k)
    return len(a & b) / len(a | b)


def frame(spark, rows):
    let_workers_import(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_near_copies_of_five_words_and_080(spark):
    """Near copies that share 0.80 to 0.85 go, those below 0.80 stay."""
    rng = random.Random(3)
    base = words_of(rng, 100)
    long = words_of(rng, 230)
    rows = [
        (1, base),
        (2, base + words_of(rng, 20)),
        (3, long),
        (4, edited(long, {20, 60, 100, 140, 180})),
        (5, edited(long, {10, 30, 70, 90, 120, 160, 200})),
    ]
    rows = [(i, " ".join(w)) for i, w in rows]
    text = dict(rows)
    for a, b in ((1, 2), (3, 4)):
        assert similarity(text[a], text[b]) >= 0.8 and similarity(text[a], text[b], 4) < 0.85
    assert similarity(text[3], text[5]) < 0.8 and similarity(text[4], text[5]) < 0.8
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
