"""Exact, reproducible train/validation splits.

A split needs no shuffle of the rows: the rows are ordered by a hash of their key,
and the key where validation begins is found from counts per key prefix. What is
left is a comparison per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiframe.functions.hashing import hash_key
from lexiframe.operators.dataset import ROW_KEYS, SEED
from lexiframe.operators.ranking import SMALL_BUCKET, key_cutoff, number_in_order
from lexiframe.operators.running import BLOCK, running_sums
from lexiframe.session import materialize

# Fixed value: default share of validation rows.
VALID_SIZE = 0.1

TRAIN, VALID = "train", "val"
# Standard errors on either side of the place where the cut-off of a class is expected.
REACH = 6.0
# And so many rows more, as the first and last keys of a class are not spread like a normal variable.
REACH_ROWS = 40.0


def _label(is_train: Column) -> Column:
    return F.when(is_train, F.lit(TRAIN)).otherwise(F.lit(VALID))


def _split_at(rows: DataFrame, n_valid_of, seed: int, keys: Sequence[str]) -> DataFrame:
    key = hash_key(seed, *keys)
    n = rows.count()
    n_valid = n_valid_of(n)
    if n_valid <= 0:
        return rows.withColumn("split", F.lit(TRAIN))
    if n_valid >= n:
        return rows.withColumn("split", F.lit(VALID))
    cutoff = key_cutoff(rows.select(key.alias("_key")), "_key", n - n_valid, n)
    return rows.withColumn("split", _label(key <= F.lit(cutoff)))


def train_val_split(
    rows: DataFrame, val_ratio: float = VALID_SIZE, seed: int = SEED, keys: Sequence[str] = ROW_KEYS
) -> DataFrame:
    """Add ``split``: exactly floor(N * val_ratio) rows are ``val``, the last in hash order."""
    return _split_at(rows, lambda n: int(n * val_ratio), seed, keys)


def ordered_split(rows: DataFrame, valid_size: float = VALID_SIZE, keys: Sequence[str] = ROW_KEYS) -> DataFrame:
    """Without shuffling: the last ceil(N * valid_size) rows in key order are ``val``."""
    ranked = number_in_order(rows, [F.asc(k) for k in keys], "_rank")
    n = ranked.count()
    n_train = n - math.ceil(n * valid_size)
    return ranked.withColumn("split", _label(F.col("_rank") <= n_train)).drop("_rank")


def class_quotas(rows: DataFrame, label: str, valid_size: float) -> DataFrame:
    """(label, n, n_train) by largest remainder, ties by label; one row per class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("n"))
    everything = W.partitionBy()
    total = F.sum("n").over(everything)
    sized = counts.withColumn("total", total.cast("decimal(19,0)"))
    n_valid = F.ceil(F.col("total").cast("double") * F.lit(valid_size))
    # Whole numbers throughout, so that equal remainders compare as equal.
    quota = F.col("n") * (F.col("total") - n_valid).cast("decimal(19,0)")
    sized = sized.withColumn("_rest", quota % F.col("total"))
    sized = sized.withColumn("_base", ((quota - F.col("_rest")) / F.col("total")).cast("long"))
    open_places = (F.col("total") - n_valid).cast("long") - F.sum("_base").over(everything)
    place = F.row_number().over(W.orderBy(F.desc("_rest"), F.asc(label)))
    return sized.select(
        label,
        F.col("n").cast("long").alias("n"),
        (F.col("_base") + (place <= open_places).cast("long")).alias("n_train"),
    )


def _cutoffs_by_prefix(hashed: DataFrame, quotas: DataFrame, label: str, n: int) -> DataFrame:
    """(label, _last) of all classes of ``quotas``, from counts per class and key prefix of ``hashed(label, _key)``.

    The rows of a class are not bounded; only one prefix per class is sorted.
    """
    # Few rows per prefix, and far fewer (class, prefix) pairs than rows.
    digits = min(8, max(1, math.ceil(math.log(max(n / SMALL_BUCKET, 1), 16))))
    head = F.substring("_key", 1, digits)
    counts = hashed.groupBy(label, head.alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts.withColumn("_at", F.conv("_head", 16, 10).cast("long")), "prefixes")
    # A class has up to 16**digits prefixes; they are summed in blocks, so a hot class is not one window.
    span, levels = 16**digits, 0
    while span > BLOCK:
        span, levels = -(-span // BLOCK) + 1, levels + 1
    reached = running_sums(counts, [label], "_at", {"_cum": "_n"}, BLOCK, levels).join(quotas, label)
    cut = reached.where((F.col("_cum") >= F.col("n_train")) & (F.col("_cum") - F.col("_n") < F.col("n_train")))
    cut = cut.select(label, "_head", (F.col("n_train") - F.col("_cum") + F.col("_n")).alias("_left"))
    cut = materialize(cut, "cuts")
    in_cut = hashed.withColumn("_head", head).join(cut, [label, "_head"])
    place = F.row_number().over(W.partitionBy(label, "_head").orderBy("_key"))
    last = in_cut.withColumn("_place", place).where(F.col("_place") == F.col("_left"))
    return last.select(label, F.col("_key").alias("_last"))


def _cutoffs(hashed: DataFrame, quotas: DataFrame, label: str, n: int) -> DataFrame:
    """(label, _last): the key of the last training row of every class that has one.

    Hash keys are spread evenly, so the cut-off of a class lies close to the share n_train / n of the key range.
    One pass counts the rows below a narrow band around it, and those of every key inside, some 4 sqrt(n)
    and 80 more for a class. Classes whose band misses, if any, are cut by counts per prefix.
    """
    share = F.col("n_train") / F.col("n")
    reach = F.lit(REACH) * F.sqrt(share * (1 - share) / F.col("n")) + F.lit(REACH_ROWS) / F.col("n")
    # The first 12 digits of a key, as numbers.
    ends = quotas.where("n_train > 0").select(
        label,
        F.lower(F.lpad(F.hex(F.floor(F.greatest(share - reach, F.lit(0.0)) * F.lit(2.0**48)).cast("long")), 12, "0")).alias("_low"),
        F.lower(F.lpad(F.hex(F.floor(F.least(share + reach, F.lit(1.0)) * F.lit(2.0**48 - 1)).cast("long")), 12, "0")).alias("_high"),
    )
    first = F.substring("_key", 1, 12)
    place = F.when(first < F.col("_low"), F.lit("")).when(first <= F.col("_high"), F.col("_key"))
    banded = hashed.join(ends, label).groupBy(label, place.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    banded = materialize(banded.where(F.col("_at").isNotNull()), "band")
    upto = W.partitionBy(label).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    reached = banded.withColumn("_cum", F.sum("_n").over(upto)).join(quotas.select(label, "n_train"), label)
    cut = reached.where((F.col("_cum") >= F.col("n_train")) & (F.col("_cum") - F.col("_n") < F.col("n_train")))
    last = materialize(cut.where(F.col("_at") != "").select(label, F.col("_at").alias("_last")), "cutoffs")
    missed = quotas.where(F.col("n_train") > 0).where(F.col(label).isNotNull()).join(last, label, "left_anti")
    missed = materialize(missed, "missed")
    if missed.isEmpty():
        return last
    rest = _cutoffs_by_prefix(hashed.join(missed.select(label), label, "left_semi"), missed, label, n)
    return materialize(last.unionByName(rest), "cutoffs")


def stratified_split(
    rows: DataFrame,
    valid_size: float = VALID_SIZE,
    seed: int = SEED,
    shuffle: bool = True,
    label: str = "y",
    keys: Sequence[str] = ROW_KEYS,
) -> DataFrame:
    """Add ``split`` with the same share of every class in validation.

    Falls back to a plain split when a class has one row, when a side would have
    fewer rows than there are classes, or when shuffling is off. The number of
    classes is bounded by the vocabulary; the rows of a class are not, so its cut-off
    is found among the keys of a narrow band.
    """
    if not shuffle:
        return ordered_split(rows, valid_size, keys)
    quotas = materialize(class_quotas(rows, label, valid_size), "quotas")
    facts = quotas.agg(
        F.min("n").alias("rarest"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.sum("n_train").alias("n_train")
    ).first()
    if facts["classes"] == 0:
        return rows.withColumn("split", F.lit(TRAIN))
    n_valid = facts["n"] - facts["n_train"]
    if facts["rarest"] < 2 or min(n_valid, facts["n_train"]) < facts["classes"]:
        return _split_at(rows, lambda n: math.ceil(n * valid_size), seed, keys)

    key = hash_key(seed, *keys)
    last = _cutoffs(rows.select(label, key.alias("_key")), quotas, label, facts["n"])
    # A class without a training row has no cut-off and is all validation.
    labelled = rows.join(last, label, "left").withColumn("split", _label(F.coalesce(key <= F.col("_last"), F.lit(False))))
    return labelled.select(*rows.columns, "split")
