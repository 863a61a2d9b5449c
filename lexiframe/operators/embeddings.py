"""Embedding tables: (id, vec), one row per vocabulary entry."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.ids import EOS, PAD, UNK, last_token
from lexiframe.functions.sequences import as_lists, last_known
from lexiframe.operators.lookup import HEAD_BYTES, lookup
from lexiframe.session import discard, materialize

# The vector of unknown words.
UNK_SEED = 42
UNK_SCALE = 0.1
UNK_INITS = ("random", "zero", "mean")
TOP_K_SIMILAR = 20

# Similarities up to this size go to every worker.
SIMS_BYTES = 256 << 20
# And up to this size the unit vectors that all blocks are compared with at a time.
CHUNK_BYTES = 256 << 20
# A cosine block is a matrix of this many rows on either side.
SIMILARITY_BLOCK = 4096


def dimension(vectors: DataFrame, vec: str = "vec") -> int:
    first = vectors.select(F.size(vec).alias("d")).first()
    if first is None:
        raise ValueError("the table holds no vectors")
    return first["d"]


def unknown_vector(vectors: DataFrame, unk_init: str = "random") -> list[float]:
    """The shared vector of words without one: seeded random, zeros, or the mean of all."""
    dim = dimension(vectors)
    if unk_init == "random":
        return [float(x) for x in np.random.RandomState(UNK_SEED).randn(dim).astype(np.float32) * np.float32(UNK_SCALE)]
    if unk_init == "zero":
        return [0.0] * dim
    if unk_init == "mean":
        means = vectors.select(F.posexplode("vec").alias("d", "v")).groupBy("d").agg(F.avg("v").alias("v"))
        # One number per dimension.
        return [r["v"] for r in means.orderBy("d").collect()]
    raise ValueError(f"unk_init is one of {UNK_INITS}, not {unk_init!r}")


def _vector(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<float>")


def align_embeddings(
    vocab: DataFrame,
    vectors: DataFrame,
    unk_init: str = "random",
    special_rules: bool = True,
    dim: int | None = None,
) -> DataFrame:
    """(id, token, vec, found): a vector for every vocabulary entry.

    Words without a vector share one. With ``special_rules`` PAD is zero, and UNK and
    EOS take the shared vector even when the file has one for them; BOS is an ordinary
    word. Without, no entry is special.
    """
    width = dimension(vectors)
    if dim is not None and dim != width:
        raise ValueError(f"vectors have {width} components, not {dim}")
    unknown = _vector(unknown_vector(vectors, unk_init))
    joined = vocab.select("id", "token").join(vectors.select("token", "vec"), "token", "left")
    vec = F.coalesce(F.col("vec"), unknown)
    if special_rules:
        vec = F.when(F.col("id") == PAD, _vector([0.0] * width)).when(F.col("id").isin(UNK, EOS), unknown).otherwise(vec)
    return joined.select("id", "token", vec.alias("vec"), F.col("vec").isNotNull().alias("found"))


def embedding_coverage(aligned: DataFrame) -> DataFrame:
    """One row: entries, entries with a vector of their own, percentage."""
    found = F.sum(F.col("found").cast("long"))
    return aligned.agg(
        F.count(F.lit(1)).alias("vocab_size"), found.alias("n_found"), (found / F.count(F.lit(1)) * 100).alias("coverage")
    )


def embedding_size_check(embeddings: DataFrame, vocab: DataFrame) -> None:
    """An error unless there is exactly one vector per vocabulary ID."""
    n_vec, n_ids = embeddings.count(), vocab.count()
    if n_vec != n_ids or not vocab.join(embeddings, "id", "left_anti").isEmpty():
        raise ValueError(f"{n_vec} vectors for the {n_ids} IDs of the vocabulary")


SIMS = "id int, sims array<double>"


def _unit(vecs: pd.Series | np.ndarray) -> np.ndarray:
    m = (vecs if isinstance(vecs, np.ndarray) else np.stack(vecs.to_numpy())).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _best(q: pd.DataFrame, m: pd.DataFrame, top_k: int) -> pd.DataFrame:
    """The ``top_k`` highest cosines of each row of ``q`` to the other rows of ``m``."""
    if q.empty or m.empty:
        return pd.DataFrame({"id": pd.Series(dtype="int32"), "sims": pd.Series(dtype=object)})
    cos = _unit(q["vec"]) @ _unit(m["vec"]).T
    cos[q["id"].to_numpy()[:, None] == m["id"].to_numpy()[None, :]] = -np.inf
    k = min(top_k, cos.shape[1])
    top = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k :]
    return pd.DataFrame({"id": q["id"].to_numpy(), "sims": [row[np.isfinite(row)] for row in top]})


def _merged(per_block: DataFrame, top_k: int) -> DataFrame:
    merged = F.sort_array(F.flatten(F.collect_list("sims")), asc=False)
    return per_block.groupBy("id").agg(F.slice(merged, 1, top_k).alias("sims"))


def nearest_similarities(embeddings: DataFrame, top_k: int = TOP_K_SIMILAR, block: int = SIMILARITY_BLOCK) -> DataFrame:
    """(id, sims): cosines of every token to its ``top_k`` nearest other tokens, descending.

    The matrix is cut into blocks of IDs. Each pair of blocks is one group of bounded
    size that returns only the best ``top_k`` per token, merged per token afterwards. The
    work grows with the square of the vocabulary. IDs may have gaps.
    """
    n = embeddings.count()
    if not 0 < top_k < n:
        raise ValueError(f"top_k must be between 1 and {n - 1}")
    own = F.floor(F.col("id") / F.lit(block)).cast("int")
    # No more than one number per ``block`` tokens, or per token of a sparse table.
    blocks = sorted(r["b"] for r in embeddings.select(own.alias("b")).distinct().collect())
    others = F.explode(F.array(*[F.lit(b) for b in blocks]))
    left = embeddings.select("id", "vec", own.alias("a")).withColumn("b", others)
    right = embeddings.select("id", "vec", own.alias("b")).withColumn("a", others)
    per_block = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(lambda q, m: _best(q, m, top_k), SIMS)
    return _merged(per_block, top_k)


def _clustered(embeddings: DataFrame, block: int, seed: int) -> tuple[DataFrame, pd.DataFrame]:
    """(id, vec, a) with blocks of like directions, and per block its ``centre`` and ``radius``, the widest angle to it."""
    n_clusters = max(1, -(-embeddings.count() // block))

    @F.arrow_udf("array<double>")
    def of_length_one(vecs: pa.Array) -> pa.Array:
        values = vecs.flatten()
        if vecs.null_count or values.null_count:
            raise ValueError("a vector is null or has a null")
        return as_lists(_unit(values.to_numpy().reshape(len(vecs), -1))) if len(vecs) else pa.array([], pa.list_(pa.float64()))

    unit = embeddings.select("id", "vec", of_length_one(F.col("vec").cast("array<double>")).alias("_v"))
    unit = materialize(unit.withColumn("features", array_to_vector("_v")).drop("_v"), "directions")
    model = KMeans(k=max(2, n_clusters), seed=seed, maxIter=10).fit(unit) if n_clusters > 1 else None
    centres = np.stack(model.clusterCenters()) if model else np.zeros((1, dimension(embeddings)))
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres / np.where(norm == 0, 1.0, norm)
    placed = model.transform(unit) if model else unit.withColumn("prediction", F.lit(0))
    sizes = placed.groupBy("prediction").count()
    parts = F.ceil(F.col("count") / block).cast("long")
    # A cluster larger than a block is dealt to several.
    placed = placed.join(sizes, "prediction").withColumn("_part", F.pmod(F.xxhash64("id"), parts))
    placed = placed.withColumn("a", F.concat_ws("-", "prediction", "_part"))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    cosine = F.aggregate(
        F.zip_with(vector_to_array("features"), F.get(table, F.col("prediction")), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x
    )
    angle = F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))).alias("_angle")
    placed = materialize(placed.select("id", "vec", "a", "prediction", angle), "clustered")
    discard(unit)
    # One row per block.
    facts = placed.groupBy("a").agg(
        F.min("prediction").alias("cluster"), F.max("_angle").alias("radius"), F.count(F.lit(1)).alias("n")
    ).toPandas()
    facts["centre"] = [centres[c] for c in facts["cluster"]]
    return placed.select("id", "vec", "a"), facts


def _chunks(sizes: list[int], most: int) -> list[list[int]]:
    """Places of ``sizes`` in runs that sum to no more than ``most``, or hold one place."""
    runs, held = [[]], 0
    for i, size in enumerate(sizes):
        if runs[-1] and held + size > most:
            runs.append([])
            held = 0
        runs[-1].append(i)
        held += size
    return runs


class _Highest:
    """The ``top_k`` highest values per row above a floor that rises with them."""

    def __init__(self, floor: np.ndarray, top_k: int):
        self.floor, self.top_k = floor.copy(), top_k
        self.rows, self.values = [np.zeros(0, np.int64)], [np.zeros(0)]
        self.pending = 0

    def add(self, rows: np.ndarray, values: np.ndarray) -> None:
        self.rows.append(rows)
        self.values.append(values)
        self.pending += len(rows)
        if self.pending > 8 * len(self.floor):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sizes, rows, values): how many a row has, and its values, highest first."""
        rows, values = np.concatenate(self.rows), np.concatenate(self.values)
        order = np.lexsort((-values, rows))
        rows, values = rows[order], values[order]
        sizes = np.bincount(rows, minlength=len(self.floor))
        rank = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = rank == self.top_k - 1
        self.floor[rows[at]] = np.maximum(self.floor[rows[at]], values[at])
        keep = rank < self.top_k
        rows, values = rows[keep], values[keep]
        self.rows, self.values, self.pending = [rows], [values], 0
        return np.minimum(sizes, self.top_k), rows, values


def _from_others(
    q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, others: Iterable[tuple[np.ndarray, np.ndarray]], top_k: int
) -> list[np.ndarray]:
    """Per row of the unit vectors ``q`` the highest cosines above ``floor`` to blocks of (IDs, unit vectors).

    Products of single precision tell which pairs can be among them, within their error; these are multiplied anew.
    """
    best, short = _Highest(floor, top_k), q.astype(np.float32)
    error = np.float32(4 * q.shape[1] * np.finfo(np.float32).eps)
    for ids, m in others:
        near = short @ m.astype(np.float32).T > (best.floor - error).astype(np.float32)[:, None]
        rows, at = np.nonzero(near)
        other = q_ids[rows] != ids[at]
        rows, at = rows[other], at[other]
        # In parts, as the first block of many equal directions may leave all of them.
        for i in range(0, len(rows), 1 << 20):
            r, c = rows[i : i + (1 << 20)], at[i : i + (1 << 20)]
            values = np.einsum("ij,ij->i", q[r], m[c])
            above = values > best.floor[r]
            best.add(r[above], values[above])
    sizes, _, values = best.merge()
    return np.split(values, np.cumsum(sizes)[:-1])


def pruned_similarities(
    embeddings: DataFrame, top_k: int = TOP_K_SIMILAR, block: int = SIMILARITY_BLOCK, seed: int = 42, max_bytes: int = CHUNK_BYTES
) -> tuple[DataFrame, int, int]:
    """The rows of ``nearest_similarities``, the pairs of blocks that were skipped, and all pairs.

    Blocks hold tokens of like directions. Every token is compared with its own block first;
    a block of others is skipped where the angle between the centres less both radii leaves
    no cosine as high as the lowest ``top_k``-th found so far. Nothing that could be among the
    best is left out. The driver holds one centre per block, and the vectors that all blocks are compared with at
    a time, no more than ``max_bytes``: they go to the workers, so that no block is copied for each of its pairs.
    """
    n = embeddings.count()
    if not 0 < top_k < n:
        raise ValueError(f"top_k must be between 1 and {n - 1}")
    placed, facts = _clustered(embeddings, block, seed)
    names = [str(a) for a in facts["a"]]
    # The number is given, as the work of a block has nothing to do with its bytes.
    dealt = placed.repartition(max(len(names), embeddings.sparkSession.sparkContext.defaultParallelism), "a")
    own = dealt.groupBy("a").applyInPandas(lambda q: _best(q, q, top_k).assign(a=q["a"].iloc[0]), f"{SIMS}, a string")
    own = materialize(own, "own-block")
    floor = F.when(F.size("sims") >= top_k, F.array_min("sims")).otherwise(F.lit(-1.0))
    floors = {r["a"]: r["f"] for r in own.groupBy("a").agg(F.min(floor).alias("f")).collect()}
    centres, radius = np.stack(facts["centre"]), facts["radius"].to_numpy()
    between = np.arccos(np.clip(centres @ centres.T, -1, 1)) - radius[:, None] - radius[None, :]
    highest = np.cos(np.clip(between, 0, np.pi))
    lowest = np.array([floors[a] for a in facts["a"]])
    wanted = (highest >= lowest[:, None] - 1e-9) & ~np.eye(len(facts), dtype=bool)
    pairs, total = int(wanted.sum()), len(names) * (len(names) - 1)
    found = own.select("id", "sims")
    bytes_of = [int(c) * dimension(embeddings) * 8 for c in facts["n"]] if pairs else []
    chunks = _chunks(bytes_of, max_bytes) if pairs else []
    for chunk in chunks:
        if not wanted[:, chunk].any():
            continue
        made = _compared(placed, dealt, names, wanted, chunk, top_k, len(chunks) > 1)
        found = found.unionByName(made)
    return _merged(found, top_k), total - pairs, total


def _compared(
    placed: DataFrame, dealt: DataFrame, names: list[str], wanted: np.ndarray, chunk: list[int], top_k: int, store: bool
) -> DataFrame:
    """(id, sims) of all blocks compared with those of ``chunk``, where ``wanted``."""
    table = placed.where(F.col("a").isin([names[i] for i in chunk])).select("a", "id", "vec").toArrow()
    blocks = {}
    for a, part in table.to_pandas().groupby("a"):
        blocks[a] = (part["id"].to_numpy(), np.stack(part["vec"].to_numpy()))
    asked = {names[i]: [names[j] for j in chunk if wanted[i, j]] for i in range(len(names))}
    shared = placed.sparkSession.sparkContext.broadcast((blocks, asked))
    del table, blocks

    def compare(q: pd.DataFrame) -> pd.DataFrame:
        held, asked = shared.value
        unit, ids = _unit(q["vec"]), q["id"].to_numpy()
        floor = np.array([s.min() if len(s) >= top_k else -np.inf for s in _best(q, q, top_k)["sims"]])
        others = ((held[a][0], _unit(held[a][1])) for a in asked[q["a"].iloc[0]])
        return pd.DataFrame({"id": ids, "sims": _from_others(ids, unit, floor, others, top_k)})

    made = dealt.groupBy("a").applyInPandas(compare, SIMS)
    if store:
        made = materialize(made, "other-blocks")
        shared.unpersist()
    return made


def similarity_table(embeddings: DataFrame, top_k: int = TOP_K_SIMILAR) -> DataFrame:
    """(id, sims) of ``pruned_similarities``, stored: computed once per vocabulary entry, then looked up."""
    return materialize(pruned_similarities(embeddings, top_k)[0], "similarities")


def similarity_matrix(
    table: DataFrame, top_k: int = TOP_K_SIMILAR, max_bytes: int = SIMS_BYTES
) -> tuple[np.ndarray, np.ndarray] | None:
    """The IDs of the table in order and their similarities; None where these are larger than ``max_bytes`` or vary in number."""
    facts = table.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("sims")).alias("least"), F.max(F.size("sims")).alias("most")).first()
    if facts["n"] * top_k * 8 > max_bytes or facts["least"] != top_k or facts["most"] != top_k:
        return None
    found = table.where(F.col("id").isNotNull()).select("id", "sims").toArrow()
    ids, sims = found["id"].to_numpy(), found["sims"].combine_chunks().flatten().to_numpy().reshape(-1, top_k)
    order = np.argsort(ids)
    return ids[order], sims[order]


def similar_to_last(shared: Broadcast, top_k: int) -> Callable[[pa.Array], np.ndarray]:
    """What looks up the last token of contexts inside a task, in the ``similarity_matrix`` in ``shared``."""

    def similar(contexts: pa.Array) -> np.ndarray:
        ids, sims = shared.value
        last = last_known(contexts, PAD)
        at = np.minimum(np.searchsorted(ids, last), len(ids) - 1)
        return np.where((ids[at] == last)[:, None], sims[at], 0.0) if len(ids) else np.zeros((len(last), top_k))

    return similar


def with_similarities(
    rows: DataFrame,
    table: DataFrame,
    top_k: int = TOP_K_SIMILAR,
    ctx: str = "ctx",
    name: str = "last_token_sims",
    head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """Add the similarities of the last token in ``table``, by a join; rows that end in a frequent token do not move."""
    zeros = F.array_repeat(F.lit(0.0), top_k)
    asked = rows.withColumn("_last", last_token(F.col(ctx)))
    # The ID is the rank of a token by frequency.
    entries = table.select(F.col("id").alias("_last"), F.col("sims").alias("_sims"), F.col("id").alias("_rank"))
    joined = lookup(asked, entries, "_last", "_rank", head_bytes)
    return joined.select(*rows.columns, F.coalesce("_sims", zeros).alias(name))


def last_token_similarity(
    rows: DataFrame,
    embeddings: DataFrame,
    top_k: int = TOP_K_SIMILAR,
    ctx: str = "ctx",
    name: str = "last_token_sims",
    head_bytes: int = HEAD_BYTES,
    max_bytes: int = SIMS_BYTES,
) -> DataFrame:
    """Add the similarities of the last token of the context; zeros when there is none.

    Up to ``max_bytes`` of similarities go to every worker and are looked up there; more are joined.
    """
    table = similarity_table(embeddings, top_k)
    found = similarity_matrix(table, top_k, max_bytes)
    if found is None:
        return with_similarities(rows, table, top_k, ctx, name, head_bytes)
    similar = similar_to_last(rows.sparkSession.sparkContext.broadcast(found), top_k)

    @F.arrow_udf("array<double>")
    def similarities(contexts: pa.Array) -> pa.Array:
        return as_lists(similar(contexts))

    return rows.select(*rows.columns, similarities(F.col(ctx)).alias(name))
