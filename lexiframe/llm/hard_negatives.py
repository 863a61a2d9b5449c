"""Hard negatives of anchor vectors by a secondary-sort shuffle.

Scores of (anchor, row) pairs are shuffled under the key (anchor, descending score, id)
and read back as a sorted stream: a positive opens a window of scores, and the negatives
that follow fall into the open windows. A stream holds the windows of one anchor and never
its rows.

All anchors meet all rows in blocks, as a stated query set: tasks hold their part of the
rows and read the anchors, a block at a time, from a table in the shared folder. Before
anything is shuffled a task keeps, exactly, what can still be part of the result: of an
anchor's own label its best rows, and then, the windows being known, of each window its
best rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.session import new_path

ANCHOR_EVERY = 50
N_POSITIVES, N_NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SCALE = 256
# A block of scores has so many anchors and rows.
ANCHOR_BLOCK, ROW_BLOCK = 512, 4096
# Scores beyond this cannot be packed with a place in a block.
MOST = 2**50
NONE = np.int64(-(2**63))


def usable(vectors: DataFrame, vector: str = "embedding") -> Column:
    """Rows with an id, a label and a vector of finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = F.coalesce(F.forall(F.col(vector).cast("array<double>"), number), F.lit(False))
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole


def _matrix(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, one row per vector; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


class Rows:
    """The part of the rows one task holds, in the order of ids, in blocks."""

    def __init__(self, batches: Iterator[pa.RecordBatch], scale: int, size: int):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), scale)) for b in batches if len(b)]
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not parts:
            return
        width = max(m.shape[1] for _, _, m in parts)
        most = max(np.abs(m).max(initial=0) for _, _, m in parts)
        # Whole numbers are exact in 32-bit floats up to 2**24, and so are sums that stay below.
        kind = np.float32 if most**2 * width < 2**24 else np.float64
        vectors = np.zeros((sum(len(m) for _, _, m in parts), width), kind)
        at = 0
        for _, _, m in parts:
            vectors[at : at + len(m), : m.shape[1]] = m
            at += len(m)
        ids, labels = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(ids, kind="stable")
        for start in range(0, len(order), size):
            take = order[start : start + size]
            self.blocks.append((ids[take], labels[take], vectors[take]))


def _anchor_blocks(folder: str, scale: int, size: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The anchors of a table in the shared folder, at most ``size`` at a time."""
    files, root = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
    found = files.get_file_info(fs.FileSelector(root))
    for path in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with files.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(size):
                if len(batch):
                    vectors = batch.column(batch.schema.get_field_index("vector"))
                    rest = batch.drop_columns(["vector"]).to_pandas()
                    yield rest, _matrix(vectors, scale)


def _packed(anchors: pd.DataFrame, queries: np.ndarray, block: tuple, same_label: bool, size: int) -> np.ndarray:
    """score * size + (place from the end) of each pair, so that larger means a higher score, then a smaller id."""
    ids, labels, vectors = block
    width = min(queries.shape[1], vectors.shape[1])
    most = max(np.abs(queries).max(initial=0), 1.0) * max(float(np.abs(vectors).max(initial=0)), 1.0)
    if most * max(width, 1) >= MOST:
        raise ValueError("inner products beyond 2**50 are not supported")
    kind = vectors.dtype if most * max(width, 1) < 2**24 else np.float64
    scores = (queries[:, :width].astype(kind) @ vectors[:, :width].astype(kind, copy=False).T).astype(np.int64)
    packed = scores * size + (size - 1 - np.arange(len(ids)))
    same = anchors["label"].to_numpy()[:, None] == labels
    packed[(same != same_label) | (anchors["vec_id"].to_numpy()[:, None] == ids)] = NONE
    return packed


def _pairs(anchors: pd.DataFrame, block: tuple, at: np.ndarray, packed: np.ndarray, kind: int, size: int) -> pa.RecordBatch:
    """Key rows of the pairs (anchor ``at``, the row that ``packed`` names)."""
    columns = [
        pa.array(anchors["anchor"].to_numpy()[at], pa.int64()),
        pa.array(-(packed // size), pa.int64()),
        pa.array(np.full(len(at), kind), pa.int32()),
        pa.array(block[0][size - 1 - packed % size], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "down", "kind", "vec_id"])


PAIR = "anchor long, down long, kind int, vec_id long"


def _best_positives(rows: DataFrame, folder: str, n: int, scale: int, sizes: tuple[int, int]) -> DataFrame:
    """Of every task and row block the ``n`` best rows of each anchor's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Rows(batches, scale, sizes[1])
        for anchors, queries in _anchor_blocks(folder, scale, sizes[0]) if held.blocks else ():
            for block in held.blocks:
                packed = _packed(anchors, queries, block, True, sizes[1])
                k = min(n, packed.shape[1])
                best = np.partition(packed, packed.shape[1] - k, axis=1)[:, -k:]
                at, j = np.nonzero(best != NONE)
                yield _pairs(anchors, block, at, best[at, j], 0, sizes[1])

    return rows.mapInArrow(run, PAIR)


def _best_negatives(rows: DataFrame, folder: str, n: int, scale: int, sizes: tuple[int, int]) -> DataFrame:
    """Of every task and row block the ``n`` best rows of another label in each window of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Rows(batches, scale, sizes[1])
        for anchors, queries in _anchor_blocks(folder, scale, sizes[0]) if held.blocks else ():
            lows, highs = (_windows(anchors[name]) for name in ("lows", "highs"))
            for block in held.blocks:
                packed = np.sort(_packed(anchors, queries, block, False, sizes[1]), axis=1)
                ats, found = [], []
                for a in range(len(packed)):
                    ends = np.searchsorted(packed[a], (highs[a] + 1) * sizes[1] - 1, "right")
                    starts = np.searchsorted(packed[a], lows[a] * sizes[1], "left")
                    starts = np.maximum(starts, ends - n)
                    kept = [packed[a, s:e] for s, e in zip(starts, ends) if s < e]
                    if kept:
                        found.append(np.unique(np.concatenate(kept)))
                        ats.append(np.full(len(found[-1]), a))
                if found:
                    yield _pairs(anchors, block, np.concatenate(ats), np.concatenate(found), 1, sizes[1])

    return rows.mapInArrow(run, PAIR)


def _windows(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray([] if x is None else x, np.int64) for x in column]


def _by_anchor(pairs: DataFrame) -> DataFrame:
    """The secondary sort: an anchor's rows in one partition, by descending score, positives first, then id."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "anchor").sortWithinPartitions("anchor", "down", "kind", "vec_id")


def _first_of_each(pairs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every anchor, from the sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, seen = None, 0
        for batch in batches:
            keep = []
            for a in batch.column(0).to_pylist():
                anchor, seen = a, seen + 1 if a == anchor else 1
                keep.append(seen <= n)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return _by_anchor(pairs).mapInArrow(run, PAIR)


def bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest negative score a positive's score admits, in whole numbers."""
    return -(-low * score // 100), high * score // 100


def _emit(pairs: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """Negatives of every positive, from the sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out = []
            for a, down, kind, vec_id in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != anchor:
                    anchor, windows = a, []
                if kind == 0:
                    windows.append([vec_id, -down, *bounds(-down, low, high), 0])
                    continue
                for window in windows:
                    positive, score, least, most, rank = window
                    if rank < n and least <= -down <= most:
                        window[4] += 1
                        out.append((a, positive, rank + 1, vec_id, score, -down))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["anchor", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return _by_anchor(pairs).mapInArrow(
        run, "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table written to the shared folder, where tasks can read it too, and its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def mine_hard_negatives(
    vectors: DataFrame,
    anchor_every: int = ANCHOR_EVERY,
    n_positives: int = N_POSITIVES,
    n_negatives: int = N_NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    vector: str = "embedding",
    sizes: tuple[int, int] = (ANCHOR_BLOCK, ROW_BLOCK),
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become floor(scale * x); a score is the whole-number inner product, higher
    first, ties by the smaller id. Anchors are the rows whose ``vec_id`` is divisible by
    ``anchor_every``; their positives the best ``n_positives`` other rows of their label.
    A positive's negatives are the best ``n_negatives`` rows of another label with
    low * positive <= 100 * negative <= high * positive. A positive without any gives no row.

    Rows with a null id, label or vector, or a null or non-finite component take no part.
    A shorter vector counts as if it ended in zeros, an empty one as all zeros. Rows of one
    id are that anchor itself to it, whatever they hold; repeated rows take part each, and
    a repeated anchor is mined as often as it occurs. Scores beyond 2**50 are an error.
    No anchors give no rows. Other columns are not read. ``sizes`` are the anchors and rows
    of a block; the result does not depend on them.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("low and high must be percentages in order")
    spark: SparkSession = vectors.sparkSession
    rows = vectors.where(usable(vectors, vector)).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col(vector).cast("array<double>").alias("vector")
    )
    chosen = rows.where(F.col("vec_id") % anchor_every == 0).withColumn("anchor", F.monotonically_increasing_id())
    anchors, folder = _stored(chosen, "anchors")
    positives, _ = _stored(_first_of_each(_best_positives(rows, folder, n_positives, scale, sizes), n_positives), "positives")
    score = -F.col("down")
    percent = lambda x: ((x - x % 100) / 100).cast("long")  # noqa: E731  whole multiples divide exactly
    window = F.struct(percent(low * score + 99).alias("low"), percent(high * score).alias("high"))
    # A negative score admits nothing: its window would end before it begins.
    opened = positives.where(score >= 0).groupBy("anchor").agg(F.collect_list(window).alias("_w"))
    asked = anchors.join(opened, "anchor").select(
        "anchor", "vec_id", "label", "vector", F.col("_w.low").alias("lows"), F.col("_w.high").alias("highs")
    )
    _, asked_folder = _stored(asked, "windows")
    negatives = _best_negatives(rows, asked_folder, n_negatives, scale, sizes)
    found = _emit(positives.unionByName(negatives), n_negatives, low, high)
    return found.join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
