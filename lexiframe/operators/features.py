"""Features of context rows: pooled embeddings, prototypes, PCA, assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiframe.functions.ids import PAD, context_length, type_token_ratio, unk_count
from lexiframe.functions.moments import Moments, merged, moments, points_of
from lexiframe.functions.sequences import as_lists, joined_windows
from lexiframe.operators.dataset import ROW_KEYS, feature_names
from lexiframe.operators.embeddings import TOP_K_SIMILAR, similar_to_last, similarity_matrix, similarity_table, with_similarities
from lexiframe.session import materialize

# Fixed values of the features.
EMPTY_MAX = -1e10
N_PROTOTYPES = 50
KMEANS_SEED = 42
KMEANS_INITS = 10

POOLS = ("mean", "max", "position")

# An embedding table up to this size (as floats) goes to every worker as a matrix: a million vectors of 64.
MATRIX_BYTES = 256 << 20
# Contexts pooled at a time inside a task; bounds the gathered block.
POOL_ROWS = 1024
# Up to so many IDs a context, contexts are pooled as windows of the sequence they are cut from.
JOINED_SHARE = 4
# IDs of a block of a larger table, and contexts that meet it in one group.
POOL_BLOCK, POOL_GROUP = 4096, 50_000
# A pass of k-means gives a task so many vectors; a smaller table stays one task.
KMEANS_ROWS = 8192


def with_context_stats(rows: DataFrame, ctx: str = "ctx") -> DataFrame:
    """Add context_length, unk_count and type_token_ratio."""
    c = F.col(ctx)
    return rows.select(
        "*",
        context_length(c).alias("context_length"),
        unk_count(c).alias("unk_count"),
        type_token_ratio(c).alias("type_token_ratio"),
    )


def matrix_if_small(embeddings: DataFrame, max_bytes: int = MATRIX_BYTES) -> tuple[np.ndarray, np.ndarray] | None:
    """The embedding table as a matrix with a mask of the IDs it has, or None when it is larger than ``max_bytes``."""
    facts = embeddings.agg(F.max("id").alias("top"), F.max(F.size("vec")).alias("dim")).first()
    if facts["top"] is None:
        raise ValueError("the embedding table has no rows")
    shape = (facts["top"] + 1, facts["dim"])
    if shape[0] * shape[1] * 4 > max_bytes:
        return None
    table = embeddings.select(F.col("id").cast("int").alias("id"), F.col("vec").cast("array<float>").alias("vec")).toArrow()
    vecs, ids = table["vec"].combine_chunks(), table["id"].to_numpy()
    if table["id"].null_count or vecs.null_count or vecs.flatten().null_count or (vecs.value_lengths().to_numpy() != shape[1]).any():
        raise ValueError("an ID or a vector of the embedding table is null, or vectors differ in length")
    matrix, present = np.zeros(shape, dtype=np.float32), np.zeros(shape[0], dtype=bool)
    matrix[ids] = vecs.flatten().to_numpy().reshape(-1, shape[1])
    present[ids] = True
    matrix[PAD], present[PAD] = 0, False
    return matrix, present


def _window_sums(values: np.ndarray, length: int, factor: float, largest: bool = False) -> np.ndarray:
    """sum of factor^j * values[i + j] over j < ``length`` for every i, or the maximum, from windows of doubled width."""

    def merge(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
        n = len(b) - apart
        if largest:
            return np.maximum(a[:n], b[apart:])
        return a[:n] + (b[apart:] if factor == 1.0 else b[apart:] * factor**apart)

    out, done, width = None, 0, 1
    while True:
        if length & width:
            out = values if out is None else merge(out, values, done)
            done += width
        if done == length:
            return out
        values, width = merge(values, values, width), 2 * width


def _held_vectors(rows: DataFrame, embeddings: DataFrame, ctx: str) -> DataFrame:
    """The vectors of the IDs that contexts hold."""

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten().unique().drop_null()], ["id"])

    held = rows.select(F.col(ctx).cast("array<int>").alias("ctx")).mapInArrow(different, "id int").distinct()
    return materialize(embeddings.join(held, "id", "left_semi").select("id", "vec"), "held")


def _matrix_in_use(rows: DataFrame, embeddings: DataFrame, ctx: str, max_bytes: int) -> tuple[np.ndarray, np.ndarray] | None:
    """``matrix_if_small`` of the table, or of the part of a larger one that contexts use."""
    small = matrix_if_small(embeddings, max_bytes)
    if small is None:
        # Texts may use a small part of a large table.
        held = _held_vectors(rows, embeddings, ctx)
        small = None if held.isEmpty() else matrix_if_small(held, max_bytes)
    return small


def _pooler(shared: Broadcast, dim: int, kinds: Sequence[str]) -> Callable[[pa.Array], dict[str, np.ndarray]]:
    """What pools a batch of contexts inside a task, from the matrix and mask in ``shared``: a matrix per kind."""

    def pool_scattered(block: np.ndarray, kind: str) -> np.ndarray:
        """One position at a time, so that the block of vectors stays in the cache."""
        vecs, present = shared.value
        n, length = block.shape
        known = (block >= 0) & (block < len(present))
        block = np.where(known, block, PAD)
        known &= present[block]
        weights = np.exp(np.arange(length) / max(length, 1)) if kind == "position" else np.ones(length)
        out = np.full((n, dim), -np.inf) if kind == "max" else np.zeros((n, dim))
        for j in range(length):
            step = vecs[block[:, j]].astype(np.float64)
            if kind == "max":
                step[~known[:, j]] = -np.inf
                np.maximum(out, step, out=out)
            else:
                out += step * (weights[j] * known[:, j])[:, None]
        if kind == "max":
            out[~known.any(axis=1)] = EMPTY_MAX
        else:
            total = known @ weights
            out /= np.where(total > 0, total, 1.0)[:, None]
        return out

    def pool(block: np.ndarray) -> dict[str, np.ndarray]:
        """Contexts that follow each other share their IDs: a vector is fetched once, and windows are put together."""
        n, length = block.shape
        ids, starts = joined_windows(block) if n and length else (block.ravel(), None)
        if starts is None or len(ids) > JOINED_SHARE * n + length:
            return {kind: pool_scattered(block, kind) for kind in kinds}
        vecs, present = shared.value
        known = (ids >= 0) & (ids < len(present))
        ids = np.where(known, ids, PAD)
        known &= present[ids]
        vectors = vecs[ids].astype(np.float64)
        out = {}
        for kind in kinds:
            if kind == "max":
                found = _window_sums(np.where(known[:, None], vectors, -np.inf), length, 1.0, True)[starts]
                found[_window_sums(known.astype(np.float64), length, 1.0)[starts] == 0] = EMPTY_MAX
            else:
                factor = np.exp(1 / length) if kind == "position" else 1.0
                total = _window_sums(known.astype(np.float64), length, factor)[starts]
                found = _window_sums(vectors, length, factor)[starts] / np.where(total > 0, total, 1.0)[:, None]
            out[kind] = found
        return out

    def pooled(contexts: pa.Array) -> dict[str, np.ndarray]:
        n = len(contexts)
        lengths = contexts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ids = contexts.flatten().fill_null(PAD).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.zeros(0, dtype=np.int64)
        results = {kind: np.empty((n, dim)) for kind in kinds}
        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            for i in range(0, len(same), POOL_ROWS):
                at = same[i : i + POOL_ROWS]
                block = ids[starts[at][:, None] + np.arange(length)[None, :]] if length else np.zeros((len(at), 0), np.int32)
                for kind, found in pool(block).items():
                    results[kind][at] = found
        return results

    return pooled


def _pool_in_tasks(
    rows: DataFrame, matrix: np.ndarray, present: np.ndarray, kinds: Sequence[str], ctx: str
) -> DataFrame:
    pooled = _pooler(rows.sparkSession.sparkContext.broadcast((matrix, present)), matrix.shape[1], kinds)

    if len(kinds) == 1:
        # An array of its own: functions of the pool run in the same pass of the worker.
        @F.arrow_udf("array<double>")
        def one_pool(contexts: pa.Array) -> pa.Array:
            return as_lists(pooled(contexts)[kinds[0]])

        return rows.withColumn(f"{kinds[0]}_pooled", one_pool(F.col(ctx)))

    fields = ", ".join(f"{k}: array<double>" for k in kinds)

    @F.arrow_udf(f"struct<{fields}>")
    def pools(contexts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([as_lists(m) for m in pooled(contexts).values()], list(kinds))

    return rows.withColumn("_pooled", pools(F.col(ctx))).select(
        *rows.columns, *[F.col(f"_pooled.{k}").alias(f"{k}_pooled") for k in kinds]
    )


def pool_by_blocks(
    rows: DataFrame,
    embeddings: DataFrame,
    kinds: Sequence[str] = POOLS,
    ctx: str = "ctx",
    keys: Sequence[str] = ROW_KEYS,
    block: int = POOL_BLOCK,
    group_rows: int = POOL_GROUP,
) -> DataFrame:
    """The same pools as a product of the sparse matrix of contexts with blocks of the embedding table.

    For tables too large to hand to every worker. A context sends each block of ``block`` IDs it
    touches one row with the IDs and their places, and gets one partial sum back, not vectors.
    A block that many rows ask for (that of the frequent words, or of UNK) is copied to as many
    groups as keep each below some ``group_rows`` rows.
    """
    dim = embeddings.select(F.size("vec").alias("d")).first()["d"]
    number = lambda x: F.floor(x / F.lit(block)).cast("long")
    places = F.transform(ctx, lambda x, i: F.struct(i.alias("j"), x.cast("long").alias("id")))
    places = F.filter(places, lambda e: (e["id"] != PAD) & (e["id"] >= 0))
    asked = rows.select(*keys, F.size(ctx).alias("_l"), places.alias("_places"))
    asked = asked.withColumn("_b", F.explode(F.array_distinct(F.transform("_places", lambda e: number(e["id"])))))
    inside = F.filter("_places", lambda e: number(e["id"]) == F.col("_b"))
    asked = asked.select(*keys, "_l", "_b", inside.alias("_in")).select(
        *keys, "_l", "_b", F.col("_in.j").alias("_j"), F.col("_in.id").alias("_id")
    )
    # One row per block of IDs.
    groups = asked.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("long").alias("_groups"))
    groups = materialize(groups, "groups")
    left = asked.join(groups, "_b").withColumn("_s", F.pmod(F.xxhash64(*keys), F.col("_groups"))).drop("_groups")
    table = embeddings.where(F.col("id") != PAD).select(F.col("id").cast("long").alias("_id"), "vec", number(F.col("id")).alias("_b"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1))
    right = table.join(groups, "_b").select("_id", "vec", "_b", copies.alias("_s"))

    made = left.select(*keys).schema
    for part in StructType.fromDDL("_n long, _w double, _total array<double>, _weighted array<double>, _most array<double>"):
        made = made.add(part)
    names = list(keys)

    def multiply(contexts: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if contexts.empty or vectors.empty:
            return pd.DataFrame(columns=made.names)
        order = np.argsort(vectors["_id"].to_numpy())
        known, m = vectors["_id"].to_numpy()[order], np.stack(vectors["vec"].to_numpy()[order]).astype(np.float64)
        sizes = contexts["_id"].map(len).to_numpy()
        of = np.repeat(np.arange(len(contexts)), sizes)
        ids, j = np.concatenate(contexts["_id"].to_numpy()), np.concatenate(contexts["_j"].to_numpy())
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        found = known[at] == ids
        of, at, weight = of[found], at[found], np.exp(j[found] / contexts["_l"].to_numpy()[of[found]])
        asking, starts = np.unique(of, return_index=True)
        out = contexts[names].iloc[asking].reset_index(drop=True)
        counts = np.diff(np.append(starts, len(of)))
        out["_n"], out["_w"] = counts, np.add.reduceat(weight, starts) if len(of) else []
        for name, wanted in (("_total", "mean"), ("_weighted", "position"), ("_most", "max")):
            if wanted not in kinds or not len(of):
                out[name] = None
            elif wanted == "max":
                out[name] = list(np.maximum.reduceat(m[at], starts))
            else:
                out[name] = list(np.add.reduceat(m[at] * (weight[:, None] if wanted == "position" else 1.0), starts))
        return out

    partial = left.groupBy("_b", "_s").cogroup(right.groupBy("_b", "_s")).applyInPandas(multiply, made)
    parts = F.collect_list(F.struct("_total", "_weighted", "_most")).alias("_parts")
    gathered = partial.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), parts)
    renamed = gathered.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_n", "_w", "_parts")
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    both = rows.join(renamed, same, "left")

    def fold(name: str, start: float, merge):
        zero = F.array_repeat(F.lit(start), dim)
        return F.aggregate("_parts", zero, lambda acc, e: F.zip_with(acc, e[name], merge))

    nothing, lowest = F.array_repeat(F.lit(0.0), dim), F.array_repeat(F.lit(EMPTY_MAX), dim)
    pools = {
        "mean": F.when(F.col("_n") > 0, F.transform(fold("_total", 0.0, lambda a, b: a + b), lambda x: x / F.col("_n"))).otherwise(nothing),
        "max": F.when(F.col("_n") > 0, fold("_most", float("-inf"), lambda a, b: F.greatest(a, b))).otherwise(lowest),
        "position": F.when(F.col("_n") > 0, F.transform(fold("_weighted", 0.0, lambda a, b: a + b), lambda x: x / F.col("_w"))).otherwise(nothing),
    }
    return both.select(*[rows[c] for c in rows.columns], *[pools[k].alias(f"{k}_pooled") for k in kinds])


def pool_embeddings(
    rows: DataFrame,
    embeddings: DataFrame,
    kinds: Sequence[str] = ("mean",),
    ctx: str = "ctx",
    keys: Sequence[str] = ROW_KEYS,
    max_bytes: int = MATRIX_BYTES,
) -> DataFrame:
    """Add ``<kind>_pooled``: mean, max or position-weighted mean of the vectors of a context.

    PAD does not count, nor does an ID without a vector. A context without any vector gives
    zeros, for ``max`` -1e10. Contexts may differ in width. The size of the table, or of what
    contexts use of it, decides how the vectors are reached, not what comes out.
    """
    unknown = set(kinds) - set(POOLS)
    if unknown:
        raise ValueError(f"unknown pooling: {sorted(unknown)}")
    small = _matrix_in_use(rows, embeddings, ctx, max_bytes)
    if small is None:
        return pool_by_blocks(rows, embeddings, kinds, ctx, keys)
    return _pool_in_tasks(rows, *small, kinds, ctx)


def fit_prototypes(
    embeddings: DataFrame, n_prototypes: int = N_PROTOTYPES, seed: int = KMEANS_SEED, n_init: int = KMEANS_INITS
) -> np.ndarray:
    """Centres of k-means over the embedding table, the best of ``n_init`` seeds.

    Fit once and keep: the centres belong to the embeddings, not to the rows. Every pass is shared by as many
    tasks as the table is large, although it may be stored in one file.
    """
    data = embeddings.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    # Counted in rows, as the splits of a file may be many and all but one empty.
    parts = -(-data.count() // KMEANS_ROWS)
    data = (data.repartition(parts) if parts > 1 else data).cache()
    try:
        fits = [KMeans(k=n_prototypes, seed=seed + i, featuresCol="features").fit(data) for i in range(n_init)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        return np.stack(best.clusterCenters())
    finally:
        data.unpersist()


def _comparer(prototypes: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The cosines of the rows of a matrix to every prototype, for use inside tasks."""
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = prototypes / np.where(norms == 0, 1.0, norms)

    def cosines(m: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return (m @ unit.T) / np.where(norm == 0, 1.0, norm)

    return cosines


def prototype_similarity(
    rows: DataFrame, prototypes: np.ndarray, pooled: str = "mean_pooled", name: str = "prototype_sims"
) -> DataFrame:
    """Add the cosines of the pooled vector to every prototype; 0 for a zero vector.

    The prototypes are n_prototypes x D numbers whatever the data.
    """
    compare, width = _comparer(prototypes), prototypes.shape[1]

    @F.arrow_udf("array<double>")
    def cosines(vectors: pa.Array) -> pa.Array:
        return as_lists(compare(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)))

    return rows.withColumn(name, cosines(F.col(pooled)))


def fit_pcas(rows: DataFrame, columns: Sequence[str], target_dim: int) -> dict[str, PipelineModel]:
    """``fit_pca`` for several columns, in one pass over the rows.

    A batch of rows leaves its worker as its count, mean and scatter, not as vectors. What centring and PCA ask of
    the rows, mean and covariance, a few points have as well, and Spark fits these.
    """

    @F.arrow_udf("struct<n: long, mean: array<double>, scatter: array<double>>")
    def batch(vectors: pa.Array) -> pa.Array:
        """The moments of a batch in its first row, nothing in the others."""
        names, n = ["n", "mean", "scatter"], len(vectors)
        found: list[dict | None] = [None] * n
        if n:
            values, widths = vectors.flatten(), vectors.value_lengths().to_numpy(zero_copy_only=False)
            if vectors.null_count or values.null_count or (widths != widths[0]).any():
                raise ValueError("a vector is null or has a null, or vectors differ in length")
            found[0] = dict(zip(names, moments(values.to_numpy().reshape(n, -1))))
        types = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        parts = [pa.array([f and np.ravel(f[c]).tolist() if c != "n" else f and f[c] for f in found], t) for c, t in zip(names, types)]
        return pa.StructArray.from_arrays(parts, names, mask=pa.array([f is None for f in found]))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per column for all rows of a task."""
        found: dict[str, Moments] = {}
        for one in batches:
            for row in one.to_pylist():
                parts = [row] if "at" in row else [{"at": c, **m} for c, m in row.items() if m]
                for p in parts:
                    mean = np.array(p["mean"])
                    part = Moments(p["n"], mean, np.array(p["scatter"]).reshape(len(mean), -1))
                    found[p["at"]] = merged([found[p["at"]], part] if p["at"] in found else [part])
        made = [{"at": c, "n": m.n, "mean": m.mean.tolist(), "scatter": m.scatter.ravel().tolist()} for c, m in found.items()]
        if made:
            yield pa.RecordBatch.from_pylist(made)

    # Were it deterministic, Spark would evaluate it once more for the filter.
    batch = batch.asNondeterministic()
    made = rows.select(*[batch(F.col(c)).alias(c) for c in columns]).where(F.coalesce(*columns).isNotNull())
    fields = "at string, n long, mean array<double>, scatter array<double>"
    table = made.mapInArrow(together, fields).repartition(1).mapInArrow(together, fields).collect()
    found = {r["at"]: Moments(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1)) for r in table}
    if not found:
        raise ValueError("a PCA is fit on at least one row")
    models = {}
    for column in columns:
        if found[column].n < 2:
            raise ValueError("a covariance needs at least two rows")
        points = [(p.tolist(),) for p in points_of(found[column])]
        data = rows.sparkSession.createDataFrame(points, "vec array<double>").coalesce(1).select(array_to_vector("vec").alias("_raw"))
        centre = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred")
        models[column] = Pipeline(stages=[centre, PCA(k=target_dim, inputCol="_centred", outputCol="_reduced")]).fit(data)
    return models


def fit_pca(rows: DataFrame, column: str, target_dim: int) -> PipelineModel:
    """Centre, then PCA: Spark's PCA does not centre on its own. Fit on training rows only."""
    return fit_pcas(rows, [column], target_dim)[column]


def reducer(model: PipelineModel) -> Callable[[np.ndarray], np.ndarray]:
    """What a model of ``fit_pca`` makes of the rows of a matrix, for use inside tasks."""
    centre, pca = model.stages
    mean, components = centre.mean.toArray(), pca.pc.toArray()
    return lambda m: (m - mean) @ components


def project(rows: DataFrame, column: str, model: PipelineModel) -> DataFrame:
    """Replace an array column by the components of ``model``, in the worker that made it where a function did."""
    reduce, width = reducer(model), len(model.stages[0].mean)

    @F.arrow_udf("array<double>")
    def components(vectors: pa.Array) -> pa.Array:
        return as_lists(reduce(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)))

    return rows.withColumn(column, components(F.col(column)))


def pca_reduce(
    rows: DataFrame, column: str, target_dim: int, model: PipelineModel | None = None, dim: int | None = None
) -> DataFrame:
    """Replace an array column by its principal components; unchanged when it has no more than ``target_dim``.

    ``dim`` is the width of the column, looked up when not given.
    """
    if dim is None:
        first = rows.select(F.size(column).alias("d")).first()
        dim = first["d"] if first else 0
    if target_dim >= dim:
        return rows
    return project(rows, column, model or fit_pca(rows, column, target_dim))


@dataclass(frozen=True)
class FeatureOptions:
    """Which features to build; the defaults need no embeddings."""

    token_ids: bool = True
    context_length: bool = True
    unk_count: bool = True
    type_token_ratio: bool = True
    mean_pooled: bool = False
    prototypes: bool = False
    last_token: bool = False
    position_pooled: bool = False
    max_pooled: bool = False
    n_prototypes: int = N_PROTOTYPES
    top_k_similar: int = TOP_K_SIMILAR
    reduce_to: int | None = None

    @property
    def needs_embeddings(self) -> bool:
        return any([self.mean_pooled, self.prototypes, self.last_token, self.position_pooled, self.max_pooled])

    def check(self, has_embeddings: bool) -> None:
        if self.needs_embeddings and not has_embeddings:
            raise ValueError("embedding features need an embedding table")
        if not any([self.token_ids, self.context_length, self.unk_count, self.type_token_ratio, self.needs_embeddings]):
            raise ValueError("no features were selected")


def _features_in_tasks(
    rows: DataFrame,
    options: FeatureOptions,
    embeddings: DataFrame,
    prototypes: np.ndarray | None,
    pca: dict[str, PipelineModel],
    ctx: str,
    kinds: Sequence[str],
    table: DataFrame | None,
    stats: Sequence[str],
) -> Column | None:
    """The vector of ``assemble_features`` made by one function, so that no part of it travels; None if tables are too large."""
    context = rows.sparkSession.sparkContext
    found = similarity_matrix(table, options.top_k_similar) if table is not None else None
    small = _matrix_in_use(rows, embeddings, ctx, MATRIX_BYTES) if kinds else None
    if (kinds and small is None) or (table is not None and found is None):
        return None
    pooled = _pooler(context.broadcast(small), small[0].shape[1], kinds) if kinds else None
    similar = similar_to_last(context.broadcast(found), options.top_k_similar) if table is not None else None
    reduce = {kind: reducer(model) for kind, model in pca.items()}
    compare = _comparer(prototypes) if options.prototypes else None
    with_ids = options.token_ids

    def assembled(contexts: pa.Array, numbers: pa.Array | None = None) -> pa.Array:
        n, blocks = len(contexts), []
        pools = pooled(contexts) if pooled else {}
        if numbers is not None:
            blocks.append(numbers.flatten().to_numpy(zero_copy_only=False).reshape(n, len(stats)))
        if options.mean_pooled:
            blocks.append(reduce["mean"](pools["mean"]) if "mean" in reduce else pools["mean"])
        if compare:
            blocks.append(compare(pools["mean"]))
        if similar:
            blocks.append(similar(contexts))
        for kind in ("position", "max"):
            if kind in pools:
                blocks.append(reduce[kind](pools[kind]) if kind in reduce else pools[kind])
        if with_ids:
            ids = contexts.flatten()
            if contexts.null_count or ids.null_count:
                raise ValueError("a context is null or has a null")
            lengths, ids = contexts.value_lengths().to_numpy(zero_copy_only=False), ids.to_numpy()
            if n and (lengths == lengths[0]).all():
                blocks.insert(0, ids.reshape(n, -1) if lengths[0] else np.zeros((n, 0)))
                lengths = None
        m = np.concatenate(blocks, axis=1)
        values, sizes = m.ravel(), np.full(n, m.shape[1])
        if with_ids and lengths is not None:
            own = np.repeat(np.tile([True, False], n), np.column_stack([lengths, sizes]).ravel())
            values = np.empty(len(own))
            values[own], values[~own] = ids, m.ravel()
            sizes = sizes + lengths
        ends = np.cumsum(sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values))
        # A dense vector as Spark stores it.
        parts = [pa.array(np.ones(n, np.int8)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), lists]
        return pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])

    if not stats:

        @F.arrow_udf(VectorUDT())
        def features(contexts: pa.Array) -> pa.Array:
            return assembled(contexts)

        return features(F.col(ctx))

    @F.arrow_udf(VectorUDT())
    def features_and_stats(contexts: pa.Array, numbers: pa.Array) -> pa.Array:
        return assembled(contexts, numbers)

    computed = {"context_length": context_length, "unk_count": unk_count, "type_token_ratio": type_token_ratio}
    return features_and_stats(F.col(ctx), F.array(*[computed[s](F.col(ctx)).cast("double") for s in stats]))


def assemble_features(
    rows: DataFrame,
    options: FeatureOptions = FeatureOptions(),
    embeddings: DataFrame | None = None,
    prototypes: np.ndarray | None = None,
    pca: dict[str, PipelineModel] | None = None,
    ctx: str = "ctx",
    keys: Sequence[str] = ROW_KEYS,
    length: int | None = None,
) -> tuple[DataFrame, list[str], list[str]]:
    """(rows with ``features``, feature names, names of the categorical ones).

    Fixed order: IDs, statistics, mean pool, prototypes, last token, position pool, max
    pool. ``prototypes`` and ``pca`` models come from training rows, as ``ContextFeatures``
    fits them: asking for these features without them is an error. ``length`` is the width
    of a context, looked up when not given.
    """
    options.check(embeddings is not None)
    if options.prototypes and prototypes is None:
        raise ValueError("prototype features need fitted prototypes")
    if length is None:
        first = rows.select(F.size(ctx).alias("n")).first()
        length = first["n"] if first else 0
    out, names, inputs, pieces = rows, [], [], None
    categorical = feature_names(length) if options.token_ids else []

    def add(column: str, width: int, label: str) -> None:
        inputs.append(F.col(column).cast("array<double>"))
        names.extend(f"{label}_{i}" for i in range(width))

    stats = [n for n in ("context_length", "unk_count", "type_token_ratio") if getattr(options, n)]
    if options.token_ids:
        inputs.append(F.col(ctx).cast("array<double>"))
        names.extend(categorical)
    if stats:
        out = with_context_stats(out, ctx)
        inputs.extend(F.array(F.col(s).cast("double")) for s in stats)
        names.extend(stats)

    if options.needs_embeddings:
        dim = embeddings.select(F.size("vec").alias("d")).first()["d"]
        wanted = {
            "mean": options.mean_pooled or options.prototypes,
            "position": options.position_pooled,
            "max": options.max_pooled,
        }
        kinds = [k for k, on in wanted.items() if on]
        reduced = dim if options.reduce_to is None else min(dim, options.reduce_to)
        to_reduce = [k for k in kinds if reduced < dim and (k != "mean" or options.mean_pooled)]
        for kind in to_reduce:
            if kind not in (pca or {}):
                raise ValueError(f"reducing the {kind} pool needs a fitted PCA")
        table = similarity_table(embeddings, options.top_k_similar) if options.last_token else None
        pieces = _features_in_tasks(rows, options, embeddings, prototypes, {k: pca[k] for k in to_reduce}, ctx, kinds, table, stats)
        if pieces is None:
            if kinds:
                out = pool_embeddings(out, embeddings, kinds, ctx, keys)
            if options.prototypes:
                out = prototype_similarity(out, prototypes)
            if options.last_token:
                out = with_similarities(out, table, options.top_k_similar, ctx)
            for kind in to_reduce:
                out = pca_reduce(out, f"{kind}_pooled", reduced, pca[kind], dim)
        if options.mean_pooled:
            add("mean_pooled", reduced, "mean")
        if options.prototypes:
            add("prototype_sims", len(prototypes), "prototype")
        if options.last_token:
            add("last_token_sims", options.top_k_similar, "similar")
        if options.position_pooled:
            add("position_pooled", reduced, "position")
        if options.max_pooled:
            add("max_pooled", reduced, "max")

    made = array_to_vector(F.concat(*inputs)) if pieces is None else pieces
    return out.select(*rows.columns, made.alias("features")), names, categorical
