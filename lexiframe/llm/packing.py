"""Length buckets with the least padding, and batches under a token budget inside them.

Texts longer than the context are cut into pieces, so lengths have at most ``max_len``
values and the histogram of all of them is small. Dynamic programming over it finds the
bucket boundaries that minimise the padding of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiframe.llm.keys import original, present
from lexiframe.llm.tokens import WordEncoder, default_path
from lexiframe.session import materialize

MAX_LEN = 2048
N_BUCKETS = 16
TOKEN_BUDGET = 65_536


def token_lengths(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)`` of ``docs(doc_id, text)``: IDs of the text and one end ID."""
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(path)
        for batch in batches:
            sizes = [len(ids) // 4 + 1 for ids in encoder.encode_all(batch["text"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": sizes})

    counted = docs.select(present("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long")
    return counted.withColumn("doc_id", original("doc_id"))


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """At most ``k`` upper bounds that minimise the sum of (bound - length) * count.

    ``best[b][j]``: the least padding of the first j lengths in b buckets. Among equal
    sums the split with the smallest index is taken. No lengths give no bounds.
    """
    n = len(lengths)
    if not n:
        return []
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    best = lengths * rows[1:] - tokens[1:]  # one bucket
    cuts = []
    for _ in range(min(k, n) - 1):
        now, cut = best.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            # The last bucket holds lengths i..j, the buckets before end at i - 1.
            cost = best[:j] + lengths[j] * (rows[j + 1] - rows[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < now[j]:
                now[j], cut[j] = cost[i], i + 1
        cuts.append(cut)
        best = now
    bounds, j = [], n - 1
    for cut in [*reversed(cuts), None]:
        if cut is not None and cut[j] == 0:
            continue  # one bucket fewer was no worse
        bounds.append(int(lengths[j]))
        if cut is None:
            break
        j = int(cut[j]) - 1
    return sorted(set(bounds))


def pack(
    lengths: DataFrame,
    max_len: int = MAX_LEN,
    n_buckets: int = N_BUCKETS,
    token_budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, n_tokens, bucket, batch, slot``.

    ``bucket`` is the padded length; a batch holds ``max(1, token_budget // bucket)`` rows
    of one bucket, in the order of ``doc_id, piece``; ``batch`` counts within the bucket.
    Rows with a length of null or zero give no piece. Repeated rows are packed each, and
    a null ``doc_id`` comes first. No rows give no pieces.

    The histogram has at most ``max_len`` rows. Places in a bucket come from a range
    partitioning of (doc_id, piece) and the prefix sums of rows per (partition, bucket),
    so a bucket with a third of all rows is spread over all tasks.
    """
    spark = lengths.sparkSession
    pieces = (
        lengths.where(F.col("n_tokens") > 0)
        .select("doc_id", F.col("n_tokens").alias("_all"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_all") - 1) / max_len).cast("int"))))
        .withColumn("start", (F.col("piece").cast("long") * max_len))
        .withColumn("n_tokens", F.least(F.lit(max_len).cast("long"), F.col("_all") - F.col("start")))
        .drop("_all")
    )
    pieces = materialize(pieces, "pieces")
    histogram = pieces.groupBy("n_tokens").count().toPandas()
    bounds = optimal_boundaries(histogram["n_tokens"].to_numpy(), histogram["count"].to_numpy(), n_buckets)
    places = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(max_len).cast("long"))
    bucketed = pieces.withColumn("bucket", F.array_min(F.filter(places, lambda b: b >= F.col("n_tokens"))))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = ["doc_id", "piece", "n_tokens"]
    placed = (
        bucketed.repartitionByRange(n, "doc_id", "piece")
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    placed = materialize(placed, "placed")
    # At most partitions x buckets rows.
    sizes = placed.groupBy("_part", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("bucket").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = materialize(
        sizes.select("_part", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "bases"
    )
    within = W.partitionBy("_part", "bucket").orderBy("_seq")
    rank = F.col("_base") + F.row_number().over(within) - 1
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket")))
    return (
        placed.join(F.broadcast(bases), ["_part", "bucket"])
        .withColumn("_rank", rank)
        .withColumn("batch", F.floor(F.col("_rank") / per_batch).cast("long"))
        .withColumn("slot", (F.col("_rank") % per_batch).cast("int"))
        .select("doc_id", "piece", "start", "n_tokens", "bucket", "batch", "slot")
    )
