"""Training rows: (previous L tokens -> next token), their profile and columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiframe.functions.hashing import hash_key
from lexiframe.functions.ids import PAD, UNK, pad_count, unk_count
from lexiframe.functions.sequences import segments
from lexiframe.operators.ranking import SMALL_BUCKET, SMALL_LIMIT, number_in_order, take_by_key, take_first
from lexiframe.operators.summary import one_row
from lexiframe.session import materialize, partition_by

# Defaults of the dataset step.
CONTEXT_LENGTH = 16
SEED = 42
TOP_TARGETS = 10

ROW_KEYS = ("doc_id", "pos")

# Positions of a piece of a document; a row on its way to its context carries one piece.
PIECE = 64
# Equal contexts meet by the least hash of their runs of so many IDs, in so many times the usual partitions.
KEY_IDS, KEY_PARTS = 4, 4


def context_windows(
    encoded: DataFrame,
    context_length: int = CONTEXT_LENGTH,
    keys: Sequence[str] = ("doc_id",),
    ids: str = "ids",
) -> DataFrame:
    """One row per position of a document encoded with BOS and EOS.

    ``pos`` counts from 1, ``y`` is the ID there, ``ctx`` the ``context_length`` IDs
    before it with PAD on the left. A narrow step: nothing is shuffled, and a reader
    of ``y`` alone does not build ``ctx``. A step that copies rows before it takes the slice,
    as Python functions do, would copy the whole document for each of its positions; so
    a document is cut into overlapping pieces first.
    """
    length = context_length
    if length < 1:
        raise ValueError("context_length must be at least 1")
    padded = encoded.where(F.size(ids) >= 2).select(
        *keys, F.concat(F.array_repeat(F.lit(PAD), length), F.col(ids)).alias("_padded")
    )
    begins = F.sequence(F.lit(0), F.size("_padded") - (length + 2), F.lit(PIECE))
    pieces = padded.select(*keys, "_padded", F.explode(begins).alias("_begin"))
    inside = F.sequence(F.col("_begin"), F.least(F.col("_begin") + (length + PIECE), F.size("_padded") - 1))
    pieces = pieces.select(*keys, "_begin", F.transform(inside, lambda i: F.get("_padded", i)).alias("_piece"))
    positions = F.sequence(F.lit(1), F.size("_piece") - (length + 1))
    rows = pieces.select(*keys, "_begin", "_piece", F.explode(positions).alias("_at"))
    return rows.select(
        *keys,
        (F.col("_begin") + F.col("_at")).alias("pos"),
        F.slice("_piece", F.col("_at") + 1, F.lit(length)).alias("ctx"),
        F.element_at("_piece", F.col("_at") + (length + 1)).alias("y"),
    )


def shuffle_rows(
    rows: DataFrame, seed: int = SEED, keys: Sequence[str] = ROW_KEYS, place: str | None = None
) -> DataFrame:
    """All rows in a reproducible random order (a range-partitioned global sort).

    With ``place``, a column of that name holds the position of the row, from 1.
    """
    order = [hash_key(seed, *keys), *[F.col(k) for k in keys]]
    return rows.orderBy(*order) if place is None else number_in_order(rows, order, place)


def limit_samples(
    rows: DataFrame,
    max_samples: int | None,
    shuffle: bool = True,
    seed: int = SEED,
    keys: Sequence[str] = ROW_KEYS,
) -> DataFrame:
    """The first ``max_samples`` rows of the shuffled order, or of document order."""
    if max_samples is None:
        return rows
    if shuffle:
        return take_by_key(rows, hash_key(seed, *keys), max_samples)
    if SMALL_LIMIT < max_samples <= SMALL_BUCKET:
        rows = _first_keys(rows, keys[0], max_samples)
    return take_first(rows, [F.asc(k) for k in keys], max_samples)


def _first_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of the lowest values of ``key``, of as many as hold ``n`` rows; nulls come first.

    Every value holds a row, so no more than ``n`` counts are summed up.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    lowest = materialize(counts.orderBy(F.asc(key)).limit(n), "counts")
    upto = W.orderBy(F.asc(key)).rowsBetween(W.unboundedPreceding, 0)
    reached = lowest.select(key, F.sum("_n").over(upto).alias("_cum")).where(F.col("_cum") >= n).orderBy(F.asc(key)).first()
    if reached is None:
        return rows
    last = F.lit(reached[0]).cast(rows.schema[key].dataType)
    return rows.where(F.col(key).isNull() | F.coalesce(F.col(key) <= last, F.lit(False)))




def _in_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, length, ids) for (ctx): contexts as windows of ``length`` of a stretch of IDs, see ``segments``."""
    absent = 1 << 40
    for batch in batches:
        contexts = batch.column(0)
        sizes = contexts.value_lengths()
        ids = contexts.flatten().cast(pa.int64()).fill_null(absent).to_numpy(zero_copy_only=False)
        lengths = sizes.fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        for length in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == length)
            keys, n, values = segments(ids[starts[at][:, None] + np.arange(length)[None, :]], KEY_IDS)
            offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            values = pa.array(np.where(values == absent, 0, values).astype(np.int32), mask=values == absent)
            found = [pa.array(keys), pa.array(np.full(len(keys), length, np.int32)), pa.ListArray.from_arrays(offsets, values)]
            yield pa.RecordBatch.from_arrays(found, ["key", "length", "ids"])
        # Contexts that are empty or null.
        rest = [None] * (sizes.null_count > 0) + [[]] * bool((sizes.fill_null(1).to_numpy(zero_copy_only=False) == 0).any())
        if rest:
            found = [pa.array([0] * len(rest), pa.int64()), pa.array([0] * len(rest), pa.int32()), pa.array(rest, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(found, ["key", "length", "ids"])


def _distinct_contexts(rows: DataFrame) -> DataFrame:
    """(key, ctx): every different context once.

    Contexts that follow each other share all IDs but one, so they travel together, as the stretch they
    are windows of, and are taken apart where equal ones meet.
    """
    contexts = rows.select(F.col("ctx").cast("array<int>").alias("ctx"))
    made = contexts.mapInArrow(_in_segments, "key long, length int, ids array<int>")
    dealt = partition_by(made, "key", times=KEY_PARTS)
    starts = F.sequence(F.lit(1), F.size("ids") - F.col("length") + 1)
    windows = F.transform(starts, lambda i: F.slice("ids", i, F.col("length")))
    parts = F.when(F.col("length") > 0, windows).otherwise(F.array("ids"))
    return dealt.select("key", F.explode(parts).alias("ctx")).distinct()


def n_unique(rows: DataFrame) -> DataFrame:
    """Different contexts and different targets, exactly.

    Two separate distinct counts: one aggregate with both would double the rows.
    """
    return one_row(
        _distinct_contexts(rows).agg(F.count(F.lit(1)).alias("n_unique_contexts")),
        rows.select("y").distinct().agg(F.count(F.lit(1)).alias("n_unique_targets")),
    )


def target_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("y").count()


# Sketches of 2^12 registers; three standard errors of their estimate.
SKETCH_BITS = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def unique_sketches(rows: DataFrame, part: Column) -> DataFrame:
    """(part, contexts, targets): HyperLogLog sketches of the rows of every part, a few kB each.

    Sketches of new rows are made alone and merged with stored ones by ``merge_unique``.
    """
    contexts = F.concat_ws(" ", F.col("ctx").cast("array<string>"))
    return rows.groupBy(part).agg(
        F.hll_sketch_agg(contexts, SKETCH_BITS).alias("contexts"), F.hll_sketch_agg("y", SKETCH_BITS).alias("targets")
    )


def merge_unique(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimates of ``n_unique`` from sketches, without the rows; the error is some 1.04 / sqrt(2^SKETCH_BITS)."""
    merged = {"n_unique_contexts": "contexts", "n_unique_targets": "targets"}
    return sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(n) for n, c in merged.items()])


def top_targets(rows: DataFrame, vocab: DataFrame, n: int = TOP_TARGETS) -> DataFrame:
    """The ``n`` most frequent targets with token, count and share."""
    # One row per vocabulary entry, so the unpartitioned window is bounded by it.
    shares = target_counts(rows).withColumn("frequency", F.col("count") / F.sum("count").over(W.partitionBy()))
    top = take_first(shares, [F.desc("count"), F.asc("y")], n)
    named = top.join(vocab.select(F.col("id").alias("y"), "token"), "y", "left")
    token = F.coalesce("token", F.concat(F.lit("ID_"), F.col("y").cast("string")))
    return named.select("y", token.alias("token"), "count", "frequency").orderBy(F.desc("count"), "y")


def padding_ratio(rows: DataFrame) -> DataFrame:
    return rows.agg((F.sum(pad_count(F.col("ctx"))) / F.sum(F.size("ctx"))).alias("padding_ratio"))


def unk_ratios(rows: DataFrame) -> DataFrame:
    return rows.agg(
        (F.sum(unk_count(F.col("ctx"))) / F.sum(F.size("ctx"))).alias("unk_ratio_x"),
        F.avg((F.col("y") == UNK).cast("double")).alias("unk_ratio_y"),
    )


def dataset_profile(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: sizes, different contexts and targets, padding and UNK shares, and the most frequent targets.

    ``top_targets`` holds (y, token, count, frequency), the most frequent first; it is empty without rows.
    """
    cells = rows.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max(F.size("ctx")).alias("context_length"),
        (F.sum(pad_count(F.col("ctx"))) / F.sum(F.size("ctx"))).alias("padding_ratio"),
        (F.sum(unk_count(F.col("ctx"))) / F.sum(F.size("ctx"))).alias("unk_ratio_x"),
        F.avg((F.col("y") == UNK).cast("double")).alias("unk_ratio_y"),
    )
    fields = ("y", "token", "count", "frequency")
    top = top_targets(rows, vocab).select(F.struct((-F.col("count")).alias("order"), *fields).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(*[t[f].alias(f) for f in fields]))
    sizes = vocab.agg(F.count(F.lit(1)).alias("vocab_size"))
    return one_row(cells, sizes, n_unique(rows), top.agg(ordered.alias("top_targets")))


def dataset_stats(rows: DataFrame, vocab: DataFrame, docs: DataFrame, **settings) -> DataFrame:
    """The profile with the number of documents and the settings of the run."""
    profile = one_row(dataset_profile(rows, vocab), docs.agg(F.count(F.lit(1)).alias("n_documents")))
    return profile.select("*", *[F.lit(v).alias(k) for k, v in settings.items()])


def dataset_metadata(rows: DataFrame) -> DataFrame:
    """One row: number of rows, context width, different targets, column types."""
    types = dict(rows.dtypes)
    return one_row(
        rows.agg(F.count(F.lit(1)).alias("n_samples"), F.max(F.size("ctx")).alias("context_length")),
        rows.select("y").distinct().agg(F.count(F.lit(1)).alias("n_unique_targets")),
    ).select("*", F.lit(types["ctx"]).alias("ctx_type"), F.lit(types["y"]).alias("y_type"))


def feature_names(context_length: int = CONTEXT_LENGTH) -> list[str]:
    """Names of the context columns, oldest first: token_t-L ... token_t-1."""
    return [f"token_t-{back}" for back in range(context_length, 0, -1)]


def feature_columns(rows: DataFrame, context_length: int = CONTEXT_LENGTH) -> DataFrame:
    """The context as one categorical column per position."""
    names = feature_names(context_length)
    others = [c for c in rows.columns if c != "ctx"]
    return rows.select(*others, *[F.col("ctx")[i].alias(n) for i, n in enumerate(names)])
