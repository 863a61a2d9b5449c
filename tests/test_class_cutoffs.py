"""The cut-offs of a stratified split come from a band of keys; the prefixes are for classes whose band misses."""

import hashlib

from pyspark.sql import functions as F

from lexiframe.operators import splitting


def expected(rows, quotas):
    keyed = sorted((hashlib.md5(f"42:{doc}:{pos}".encode()).hexdigest(), doc, pos, y) for doc, pos, y in rows)
    seen, out = {}, set()
    for _, doc, pos, y in keyed:
        seen[y] = seen.get(y, 0) + 1
        out.add((doc, pos, y, "train" if seen[y] <= quotas[y] else "val"))
    return out


def test_cutoffs_without_and_with_prefixes(spark, monkeypatch):
    rows = [(d, p, d * d % 7 if p % 50 else 9) for d in range(60) for p in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, y int")
    quotas = {r["y"]: r["n_train"] for r in splitting.class_quotas(df, "y", 0.1).collect()}
    by_prefix = splitting._cutoffs_by_prefix

    def refuse(*args):
        raise AssertionError("the band has missed")

    monkeypatch.setattr(splitting, "_cutoffs_by_prefix", refuse)
    found = splitting.stratified_split(df, 0.1).select("doc_id", "pos", "y", "split")
    assert {tuple(r) for r in found.collect()} == expected(rows, quotas)
    # Bands of no width miss.
    monkeypatch.setattr(splitting, "_cutoffs_by_prefix", by_prefix)
    monkeypatch.setattr(splitting, "REACH", 0.0)
    monkeypatch.setattr(splitting, "REACH_ROWS", 0.0)
    found = splitting.stratified_split(df, 0.1).select("doc_id", "pos", "y", "split")
    assert {tuple(r) for r in found.collect()} == expected(rows, quotas)
    assert found.where(F.col("split") == "val").count() == len(rows) - sum(quotas.values())
