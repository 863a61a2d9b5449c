"""Next-token model: a table of next-token probabilities by context, with back-off.

A row (ctx, token_id, n, p) says how often a token came after the IDs in ``ctx``. Contexts
of every length up to ``order`` are in the table, the empty one included. A context is
scored by its longest suffix in the table, over the whole vocabulary. Scores stay in long
form, one row per context and token, so nothing grows with contexts x vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiframe.operators.metrics import EPS
from lexiframe.session import materialize

ORDER = 2


@dataclass(frozen=True)
class NextTokenModel:
    """``table(ctx, token_id, n, p)`` and ``heads(ctx, best, seen, mass)``, one row per context.

    ``best`` is the most likely token, ``seen`` the number of tokens in the table, ``mass``
    the sum of their clipped probabilities.
    """

    order: int
    table: DataFrame
    heads: DataFrame


def suffix(ctx: Column, length: int) -> Column:
    """The last ``length`` IDs of a context; all of a shorter one."""
    return F.slice(ctx, F.greatest(F.size(ctx) - length, F.lit(0)) + 1, F.lit(length))


def _clipped(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def _hash(ctx: Column | str) -> Column:
    """Goes before a context where rows are sorted by it: numbers are compared much faster than arrays."""
    return F.xxhash64(ctx)


def count_targets(rows: DataFrame, order: int = ORDER, by: Sequence[str] = ()) -> DataFrame:
    """(by..., ctx, y, n): how often a target came after the last ``order`` IDs of a context; equal pairs are one row."""
    ids = suffix(F.col("ctx").cast("array<int>"), order)
    return rows.groupBy(*by, ids.alias("ctx"), F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))


def fit_next_token_model(rows: DataFrame, order: int = ORDER, counted: bool = False) -> NextTokenModel:
    """Count ``rows(ctx, y)``, or take those of ``count_targets`` for the same order as they are. No rows give an empty model.

    Rows are counted once, by their longest context; the counts of shorter ones are sums
    of these. The windows run over one context, which has at most as many rows as the
    vocabulary has tokens; one sort gives the probabilities and what is known of the whole context.
    """
    longest = rows if counted else materialize(count_targets(rows, order), "longest")
    longest = longest.select("ctx", F.col("y").alias("token_id"), "n")
    counts = longest.where(F.size("ctx") == order)
    for length in range(order):
        shorter = longest.where(F.size("ctx") >= length).groupBy(suffix(F.col("ctx"), length).alias("ctx"), "token_id")
        counts = counts.unionByName(shorter.agg(F.sum("n").alias("n")))
    whole = W.partitionBy("_hash", "ctx")
    sums = counts.withColumn("_hash", _hash("ctx")).select(
        "*", F.sum("n").over(whole).alias("_total"), F.max("n").over(whole).alias("_top"), F.count(F.lit(1)).over(whole).alias("seen")
    )
    sums = sums.withColumn("p", F.col("n") / F.col("_total"))
    # The lowest of the most frequent tokens is the best one, as in ``pick_greedy``.
    best = F.min(F.when(F.col("n") == F.col("_top"), F.col("token_id"))).over(whole)
    sums = sums.select("*", best.alias("best"), F.sum(_clipped(F.col("p"))).over(whole).alias("mass"))
    table = materialize(sums.select("ctx", "token_id", "n", "p", "best", "seen", "mass"), "next-token")
    heads = table.where(F.col("token_id").eqNullSafe(F.col("best"))).select("ctx", "best", "seen", "mass")
    return NextTokenModel(order, table.select("ctx", "token_id", "n", "p"), materialize(heads, "heads"))


def _with_heads(rows: DataFrame, model: NextTokenModel, facts: Sequence[str]) -> DataFrame:
    """Add ``known``, the longest suffix of ``ctx`` that is a context of the model, and these columns of its head."""
    out = rows
    for length in range(model.order, 0, -1):
        head = F.struct(F.col("ctx").alias("known"), *facts).alias(f"_found{length}")
        found = model.heads.where(F.size("ctx") == length)
        found = found.select(_hash("ctx").alias("_hash"), F.col("ctx").alias("_suffix"), head)
        out = out.withColumn("_suffix", suffix(F.col("ctx").cast("array<int>"), length)).withColumn("_hash", _hash("_suffix"))
        out = out.join(found, ["_hash", "_suffix"], "left").drop("_hash", "_suffix")
    none = F.array().cast("array<int>")
    if facts:
        # The empty context is one row.
        empty = model.heads.where(F.size("ctx") == 0).select(F.struct(F.col("ctx").alias("known"), *facts).alias("_found0"))
        out = out.join(F.broadcast(empty), F.lit(True), "left")
    heads = [F.col(f"_found{n}") for n in range(model.order, -1 if facts else 0, -1)]
    head = F.coalesce(*heads)
    return out.select(
        *[F.col(c) for c in rows.columns], F.coalesce(head["known"], none).alias("known"), *[head[f].alias(f) for f in facts]
    )


def with_known_context(rows: DataFrame, model: NextTokenModel) -> DataFrame:
    """Add ``known``, the longest suffix of ``ctx`` that is a context of the model."""
    if model.order == 0:
        return rows.withColumn("known", F.array().cast("array<int>"))
    return _with_heads(rows, model, ())


def predict_proba(rows: DataFrame, model: NextTokenModel, keys: Sequence[str]) -> DataFrame:
    """(keys..., token_id, p): the tokens that came after the known context of each row."""
    table = model.table.select(F.col("ctx").alias("known"), "token_id", "p")
    return with_known_context(rows.select(*keys, "ctx"), model).join(table, "known").select(*keys, "token_id", "p")


def score_targets(rows: DataFrame, model: NextTokenModel, vocab_size: int, eps: float = EPS) -> DataFrame:
    """``rows(ctx, y, ...)`` with ``y_pred`` and ``loss``.

    Loss is -ln of the clipped probability of ``y``, renormalised over the vocabulary, as in
    ``metrics.row_logloss``: tokens that the context was not seen with count ``eps``
    each. A model without rows predicts nothing, and all tokens alike.
    """
    table = model.table.select(_hash("ctx").alias("_hash"), F.col("ctx").alias("known"), F.col("token_id").alias("y"), F.col("p").alias("_p"))
    scored = _with_heads(rows, model, ("best", "seen", "mass")).withColumn("_hash", _hash("known"))
    scored = scored.join(table, ["_hash", "known", "y"], "left")
    total = F.col("mass") + (F.lit(vocab_size) - F.col("seen")) * F.lit(eps)
    share = F.coalesce(_clipped(F.coalesce("_p", F.lit(0.0)), eps) / total, F.lit(1.0 / max(vocab_size, 1)))
    return scored.select(*[F.col(c) for c in rows.columns], F.col("best").alias("y_pred"), (-F.log(share)).alias("loss"))


def model_report(
    rows: DataFrame, model: NextTokenModel, vocab_size: int, by: Sequence[str] = ("split",), counted: bool = False, **settings
) -> DataFrame:
    """Size, accuracy, logloss and perplexity of ``rows(ctx, y, by...)``, and the given settings.

    Equal (context, target) pairs are counted before they are joined with the model; ``counted`` rows are those of
    ``count_targets`` for the model's order.
    """
    pairs = (rows if counted else count_targets(rows, model.order, by)).withColumnRenamed("n", "_n")
    scored = score_targets(pairs, model, vocab_size)
    total = F.sum("_n")
    hit = F.when(F.col("y") == F.col("y_pred"), F.col("_n")).otherwise(F.lit(0))
    loss = F.sum(F.col("_n") * F.col("loss")) / total
    report = scored.groupBy(*by).agg(
        total.alias("n_rows"), (F.sum(hit) / total).alias("accuracy"), loss.alias("logloss"), F.exp(loss).alias("perplexity")
    )
    return report.select("*", *[F.lit(v).alias(k) for k, v in settings.items()])


def save_model(model: NextTokenModel, path: str) -> None:
    model.table.write.mode("overwrite").parquet(f"{path}/table")
    model.heads.withColumn("order", F.lit(model.order)).write.mode("overwrite").parquet(f"{path}/heads")


def load_model(spark: SparkSession, path: str) -> NextTokenModel:
    heads = spark.read.parquet(f"{path}/heads")
    order = heads.agg(F.max("order")).first()[0]
    return NextTokenModel(order or 0, spark.read.parquet(f"{path}/table"), heads.drop("order"))
