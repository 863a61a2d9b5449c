"""Exact selection by rank without moving all rows to one task.

A ``row_number()`` without ``partitionBy`` puts every row in one task, and so does
``orderBy().limit(n)`` with a large ``n``. The functions here find the rank, or only
the cut-off, from counts per range, which are small whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiframe.session import materialize

# Up to this many rows one task may merge a top-n.
SMALL_LIMIT = 10_000
# A histogram bucket with at most this many rows is sorted as it is.
SMALL_BUCKET = 100_000
PREFIX_DIGITS = 3
KEY_DIGITS = 32


def number_in_order(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Add the exact 1-based rank of every row in ``order``.

    The global sort is range-partitioned; a row's rank is its place in its
    partition plus the sizes of the partitions before. The sorted rows are written
    once, so that sizes and places come from the same partitioning even when an
    executor is lost in between.
    """
    placed = df.orderBy(*order).withColumn("_seq", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked").withColumn("_part", F.shiftright("_seq", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    # One row per sort partition, so the unpartitioned window stays small.
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # Written, its size is known, and the ranked rows are not shuffled for the join.
    starts = materialize(starts, "starts")
    return (
        placed.join(starts, "_part")
        .withColumn(name, F.col("_seq") - F.col("_first") + F.col("_start") + 1)
        .drop("_seq", "_part", "_first", "_start")
    )


def take_first(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, for any ``n``."""
    if n <= SMALL_LIMIT:
        return df.orderBy(*order).limit(n)
    ranked = number_in_order(df, order, "_rank")
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def _from_histogram(keys: DataFrame, key: str, n: int, prefix: str = "") -> str:
    """The ``n``-th smallest key, from counts per next digits (at most 16**PREFIX_DIGITS rows)."""
    width = len(prefix) + PREFIX_DIGITS
    counts = keys.groupBy(F.substring(key, 1, width).alias("head")).count()
    rest = n
    for head, count in sorted((r["head"], r["count"]) for r in counts.collect()):
        if rest <= count:
            break
        rest -= count
    bucket = keys.where(F.col(key).startswith(head)).select(key)
    if count <= SMALL_BUCKET or len(head) >= KEY_DIGITS:
        return bucket.orderBy(key).limit(rest).agg(F.max(key)).first()[0]
    return _from_histogram(bucket, key, rest, head)


def _hex(fraction: float) -> str:
    """A key at this fraction of the key range."""
    return f"{min(max(int(fraction * 2**52), 0), 2**52 - 1):013x}".ljust(KEY_DIGITS, "0")


def key_cutoff(keys: DataFrame, key: str, n: int, total: int | None = None) -> str | None:
    """The ``n``-th smallest of hash keys; None when there are no more than ``n``.

    Hash keys are spread evenly, so the cut-off lies close to the fraction n / total of
    the range. One pass counts the keys below a narrow band around it and keeps those
    inside, some 12 sqrt(n) of them; the exact place is found among these. Should the
    band miss, counts per prefix find it.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    total = keys.count() if total is None else total
    if total <= n:
        return None
    share = n / total
    reach = 6 * (share * (1 - share) / total) ** 0.5 + 2 / total
    low, high = _hex(share - reach), _hex(share + reach)
    place = F.when(F.col(key) < low, F.lit("")).when(F.col(key) > high, F.lit("~")).otherwise(F.col(key))
    band = materialize(keys.groupBy(place.alias("_at")).count(), "band")
    below = band.where(F.col("_at") == "").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    inside = band.where((F.col("_at") != "") & (F.col("_at") != "~")).select(F.col("_at").alias(key), "count")
    facts = inside.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    held, inside = facts["rows"], inside.select(key)
    # Equal keys, or a band that missed: counts per prefix tell.
    if facts["keys"] < held or not below < n <= below + held:
        return _from_histogram(keys, key, n)
    if held > SMALL_BUCKET:
        return _from_histogram(inside, key, n - below)
    return inside.orderBy(key).limit(n - below).agg(F.max(key)).first()[0]


def take_by_key(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash keys: a sample of exact size, in no promised order.

    Of rows with equal keys at the cut-off any are taken, so many that the size is exact.
    """
    if n <= SMALL_LIMIT:
        return df.withColumn("_key", key).orderBy("_key").limit(n).drop("_key")
    cutoff = key_cutoff(df.select(key.alias("_key")), "_key", n)
    if cutoff is None:
        return df
    at = df.select(key.alias("_key")).agg(
        F.count(F.when(F.col("_key") < cutoff, 1)).alias("below"), F.count(F.when(F.col("_key") == cutoff, 1)).alias("tied")
    )
    below, tied = at.first()
    if below + tied <= n:
        return df.where(key <= F.lit(cutoff))
    return df.where(key < F.lit(cutoff)).union(df.where(key == F.lit(cutoff)).limit(n - below))
