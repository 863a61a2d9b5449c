"""Passages that repeat across documents, by seed and extend over winnowed anchors.

Winnowing picks in every window of ``min_words`` words the k-word run with the smallest
hash (the last of equals); equal windows pick the same run at the same place, so anchors are
seeds that no repeat can miss. Around an anchor stands its *stretch*: the words of all
windows that picked it. Occurrences of an anchor with the same stretch match over all of it;
only where stretches of one anchor differ (at the ends of a repeat, around an edit) the
match is extended from the anchor window by window. Adjoining windows make up maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.keys import original, present
from lexiframe.llm.words import BASES, Powers, Rolling, WordHashes, covered, mix, release_memory, signed
from lexiframe.session import discard, materialize

MIN_WORDS = 50
ANCHOR_WORDS = 12
# Windows whose anchors are sought at a time, so that a very long text needs no large matrix.
CHUNK = 1 << 12


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(hashes: np.ndarray, powers: Powers, min_words: int, k: int) -> tuple[np.ndarray, ...]:
    """``(anchor, place, first window, number of windows)`` of each anchor of one text."""
    runs = Rolling(hashes, powers).runs(k)
    span = min_words - k + 1
    n = len(hashes) - min_words + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    place = np.empty(n, np.int64)
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        views = np.lib.stride_tricks.sliding_window_view(runs[a : b + span - 1], span)
        place[a:b] = np.arange(a, b) + span - 1 - views[:, ::-1].argmin(axis=1)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    count = np.diff(np.concatenate([first, [n]]))
    return runs[place[first]], place[first], first, count


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """``(doc_id, __text, start, n)``: ``n`` windows from ``start`` on also start in an earlier document.

    ``docs`` has ``doc_id, __text, text``. "Earlier" is by smaller doc_id; a null id, read as NO_ID, is the largest. Groups are reduced to their smallest id before they are
    shuffled, joins are on single occurrences, and no pair of documents is ever built: a passage in a third
    of all documents is one short row.
    """
    docs = docs.select("doc_id", "__text", "text")
    first_of = F.col("doc_id")

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, low, high = WordHashes(), Powers(BASES[0]), Powers(BASES[1])
        for batch in batches:
            out = []
            for i, text in enumerate(batch["text"]):
                words = words_of(text)
                if len(words) < min_words:
                    continue
                h = hashes.of(words)
                anchor, _, first, count = anchors(h, low, min_words, k)
                stretch = Rolling(mix(h ^ np.uint64(BASES[1])), high).between(first, first + count + min_words - 1)
                out.append((np.full(len(first), i), signed(anchor), signed(stretch), first, count))
            if not out:
                continue
            at, anchor, stretch, first, count = (np.concatenate(c) for c in zip(*out))
            keys = {c: batch[c].to_numpy()[at] for c in ("doc_id", "__text")}
            yield pd.DataFrame({**keys, "anchor": anchor, "stretch": stretch, "start": first, "n": count})
        hashes.clear()
        release_memory()

    schema = "doc_id long, __text long, anchor long, stretch long, start int, n int"
    found = materialize(docs.mapInPandas(seeds, schema), "anchors")
    # One row per different stretch, with the first and last document that has it.
    stretches = materialize(
        found.groupBy("anchor", "stretch").agg(F.min(first_of).alias("_first"), F.max(first_of).alias("_last")),
        "stretches",
    )
    # Anchors with different stretches in different documents.
    forks = (
        stretches.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("c"), F.min("_first").alias("a"), F.max("_last").alias("b"))
        .where((F.col("c") > 1) & (F.col("a") < F.col("b")))
        .select("anchor", F.lit(True).alias("_fork"))
    )
    of_use = stretches.join(forks, "anchor", "left").where(F.col("_fork") | (F.col("_last") > F.col("_first")))
    marked = materialize(
        found.join(of_use.select("anchor", "stretch", "_first", "_fork"), ["anchor", "stretch"])
        .where(F.col("_fork") | (first_of > F.col("_first")))
        .select("doc_id", "__text", "anchor", "start", "n", (first_of > F.col("_first")).alias("whole")),
        "marked",
    )
    discard(found, stretches)
    # A later document with the same stretch repeats all of its windows.
    whole = marked.where("whole").select("doc_id", "__text", "start", "n")
    # In the first document of a stretch the match with other stretches is extended window by window.
    places = (
        marked.where(~F.col("whole"))
        .groupBy("doc_id", "__text")
        .agg(F.collect_list(F.struct("anchor", "start", "n")).alias("places"))
    )

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, high = WordHashes(), Powers(BASES[1])
        for batch in batches:
            out = []
            for i, (text, places) in enumerate(zip(batch["text"], batch["places"])):
                words = words_of(text)
                runs = Rolling(mix(hashes.of(words) ^ np.uint64(BASES[1])), high).runs(min_words)
                for p in places:
                    at = np.arange(p["start"], p["start"] + p["n"])
                    out.append((np.full(len(at), i), np.full(len(at), p["anchor"]), signed(runs[at]), at))
            if not out:
                continue
            at, anchor, window, start = (np.concatenate(c) for c in zip(*out))
            keys = {c: batch[c].to_numpy()[at] for c in ("doc_id", "__text")}
            yield pd.DataFrame({**keys, "anchor": anchor, "window": window, "start": start})
        hashes.clear()
        release_memory()

    windows = docs.join(places, ["doc_id", "__text"]).select("doc_id", "__text", "text", "places").mapInPandas(
        extend, "doc_id long, __text long, anchor long, window long, start int"
    )
    windows = materialize(windows, "windows")
    earliest = windows.groupBy("anchor", "window").agg(F.min(first_of).alias("_first"), F.max(first_of).alias("_last"))
    earliest = earliest.where(F.col("_last") > F.col("_first"))
    parts = (
        windows.join(earliest, ["anchor", "window"])
        .where(first_of > F.col("_first"))
        .select("doc_id", "__text", "start", F.lit(1).alias("n"))
    )
    # Short rows in place of the tables they come from.
    repeats = materialize(whole.union(parts), "repeats")
    discard(marked, windows)
    return repeats


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows that share a doc_id are told apart by their text."""
    return docs.withColumn("doc_id", present("doc_id")).withColumn("__text", F.xxhash64("text"))


def maximal_repeats(docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """``(doc_id, spans)`` of documents with passages that also stand in a document with a smaller id.

    ``spans`` lists the maximal runs of covered words as (start, end), in order.
    """
    found = repeated_windows(_keyed(docs), min_words, k)
    runs = found.groupBy("doc_id", "__text").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("runs"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc, run):
        start, end = run["start"], run["start"] + run["n"] + (min_words - 1)
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))
        new = F.array(F.struct(start.alias("start"), end.alias("end")))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))
        return F.when(F.size(acc) == 0, new).when(start <= last["end"], grown).otherwise(F.concat(acc, new))

    return runs.select(original("doc_id"), F.aggregate("runs", none, merge).alias("spans"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """Each row of ``docs(doc_id, text, ...)`` with ``kept_text, n_words, n_removed, kept_sha256``;
    other columns stay.

    Removed is every word inside a window of ``min_words`` words (runs of characters other
    than the six ASCII white spaces) whose word sequence also starts in a document with a
    smaller doc_id; windows are judged on the input. ``kept_text`` is the text itself if nothing
    is removed, else the kept words joined by one space; the digest (lowercase hex) is of the kept words so joined. A null text has no words and stays null;
    empty and short texts lose nothing; rows with one doc_id do not repeat each other; a null doc_id counts as the largest.

    The text is shuffled by key where it meets its repeats, once here and once, for the
    documents whose repeats have loose ends, in ``repeated_windows``.
    """
    keyed = _keyed(docs)
    found = repeated_windows(keyed, min_words, k)
    runs = found.groupBy("doc_id", "__text").agg(F.collect_list(F.struct("start", "n")).alias("__runs"))
    joined = keyed.join(runs, ["doc_id", "__text"], "left").withColumn("doc_id", original("doc_id"))

    @F.pandas_udf("kept_text string, n_words long, n_removed long, kept_sha256 string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        rows = []
        for text, spans in zip(texts, runs):
            words = words_of(text)
            if spans is None or not len(spans):
                rows.append((text, len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()))
                continue
            start = np.fromiter((s["start"] for s in spans), np.int64, len(spans))
            size = np.fromiter((s["n"] for s in spans), np.int64, len(spans)) + (min_words - 1)
            gone = covered(start, size, len(words))
            kept = b" ".join([w for w, g in zip(words, gone) if not g])
            digest = hashlib.sha256(kept).hexdigest()
            rows.append((kept.decode("utf-8", "surrogatepass"), len(words), int(gone.sum()), digest))
        return pd.DataFrame(rows, columns=["kept_text", "n_words", "n_removed", "kept_sha256"])

    # Else a caller's filter on the result would cut every text a second time, in a second worker beside the first.
    return joined.withColumn("__cut", cut.asNondeterministic()("text", "__runs")).select(
        *[F.col(c) for c in docs.columns], "__cut.kept_text", "__cut.n_words", "__cut.n_removed", "__cut.kept_sha256"
    )
