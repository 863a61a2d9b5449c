"""Importance resampling towards a target distribution.

Hashed word features of the documents and of the target texts are counted; the gain of a
bucket is the logarithm of how much likelier it is in the target. A document's weight is
the mean gain of its features, its score the weight plus Gumbel noise from a hash of its
id, so that the highest scores are a draw without replacement. The cut-off of the draw is
found by bisection: exact count jobs over the stored scores, and over the ids of rows tied
at it. Only the drawn rows are range-partitioned, for their ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.keys import NO_ID
from lexiframe.operators.ranking import number_in_order
from lexiframe.session import materialize

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
LONGEST_RUN = 1
# Gains and noise are whole numbers of 1/SCALE.
SCALE = 1000
# Each job of the bisection counts at so many places less one: four halvings a job.
FANOUT = 16
# A worker forgets its cache beyond this many words.
CACHE_WORDS = 200_000

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
# A-Z to a-z; what is neither a digit, a letter nor part of a character beyond ASCII separates.
_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEPT else 32 for b in range(256)
)


class _Buckets(dict):
    """Word (bytes) -> the crc32 of its bytes."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word)
        if len(word) <= 64:
            self[word] = value
        return value


class Features:
    """The buckets of all runs of 1 to ``longest`` words of a text, repeats included."""

    def __init__(self, buckets: int, longest: int):
        self.buckets, self.longest, self.seen = buckets, longest, _Buckets()

    def of(self, text: bytes | None) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of every feature."""
        words = text.translate(_LOWER).split() if text else []
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        found = [np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))]
        for n in range(2, self.longest + 1):
            # The checksum of a run goes on from that of the run without its last word.
            runs = [zlib.crc32(b" " + w, int(c)) for c, w in zip(found[-1][: len(words) - n + 1], words[n - 1 :])]
            found.append(np.array(runs, np.int64))
        return len(words), np.concatenate(found) % self.buckets


def count_features(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts: one array per task, added up in Spark, at most ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                total += np.bincount(features.of(value.as_py())[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counted = texts.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(SCALE * ln of the ratio of the smoothed shares), in doubles."""
    n = len(source)
    all_source, all_target = float(source.sum() + n), float(target.sum() + n)
    return np.array(
        [math.floor(SCALE * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source, target)],
        np.int64,
    )


def gumbel(seed: int, doc_id: int | None) -> int:
    """Whole-number Gumbel noise from the hash of ``seed:doc_id``; a null id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of every row of ``docs(doc_id, text)``."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets, longest)
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                n_words, found = features.of(value.as_py())
                weight = int(gain[found].sum()) // len(found) if len(found) else 0
                rows.append((doc_id, n_words, len(found), weight, weight + gumbel(seed, doc_id)))
            names = ["doc_id", "n_words", "n_features", "weight", "score"]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long"
    )


def nth_smallest(values: DataFrame, column: str, n: int) -> tuple[int, int]:
    """The ``n``-th smallest whole number of a column without nulls, and how many are smaller, by bisection.

    Each job counts exactly how many values lie at or below FANOUT - 1 places of the
    range that is left. Nothing but these counts comes to the driver.
    """
    low, high = values.agg(F.min(column), F.max(column)).first()
    smaller = 0
    while low < high:
        step = -(-(high - low + 1) // FANOUT)
        places = [p for p in (low + step * i - 1 for i in range(1, FANOUT)) if p < high]
        counts = values.agg(*[F.count(F.when(F.col(column) <= p, 1)).alias(f"_{i}") for i, p in enumerate(places)]).first()
        for place, count in zip(places, counts):
            if count >= n:
                high = place
                break
            low, smaller = place + 1, count
    return low, smaller


def _drawn(rows: DataFrame, n: int) -> Column:
    """Which rows are the first ``n`` by ``_down, _id, _row`` (three unique longs, all ascending)."""
    tied, drawn = rows, F.lit(False)
    here = F.lit(True)
    for column in ("_down", "_id", "_row"):
        cut, smaller = nth_smallest(tied, column, n)
        drawn = drawn | (here & (F.col(column) < cut))
        here = here & (F.col(column) == cut)
        n -= smaller
        tied = tied.where(F.col(column) == cut)
    return drawn | here


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST_RUN,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs(doc_id, text)``, all long.

    Of the N rows with at least ``min_words`` words floor(percent * N / 100) are drawn: the
    highest scores, ties to the smaller ``doc_id``, null ids last. ``rank`` counts them from
    1 in that order and is null for all others. Null and empty texts have no features and
    weight 0. Repeated ids have equal noise, so repeated rows tie; of rows that are equal in score
    and id any are drawn, exactly as many as are due. No documents give no rows; an empty
    target weighs every bucket by the documents alone. Other columns are not read.

    The text is read twice, for the counts and for the weights. The scores are stored; all
    later steps read whole numbers only.
    """
    gain = gains(count_features(docs, buckets, longest), count_features(target, buckets, longest))
    scored = materialize(
        score_documents(docs, gain, longest, seed)
        .withColumn("_down", -F.col("score"))
        .withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
        .withColumn("_row", F.monotonically_increasing_id()),
        "scores",
    )
    candidate = F.col("n_words") >= min_words
    candidates = scored.where(candidate)
    n = percent * candidates.count() // 100
    names = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if n == 0:
        return scored.select(*names, unranked)
    drawn = candidate & _drawn(candidates.select("_down", "_id", "_row"), n)
    ranked = number_in_order(scored.where(drawn), ["_down", "_id", "_row"])
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).unionByName(
        scored.where(~drawn).select(*names, unranked)
    )
