"""Sampling rules over a table of scored tokens.

Input: (ctx..., token_id, p), one row per context and token. A context has at most
as many rows as the vocabulary has tokens, so the windows below are bounded by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiframe.functions.hashing import unit_draw

# Defaults of the sampling rules.
TOP_K = 10
TOP_P = 0.9
TEMPERATURE = 1.0
LOG_FLOOR = 1e-10
METHODS = ("greedy", "top_k", "top_p", "temperature")


def _renormalised(scored: DataFrame, ctx: Sequence[str]) -> DataFrame:
    return scored.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy(*ctx)))


def _best_first(ctx: Sequence[str]):
    return W.partitionBy(*ctx).orderBy(F.desc("p"), F.asc("token_id"))


def apply_temperature(scored: DataFrame, temperature: float = TEMPERATURE, ctx: Sequence[str] = ("ctx_id",)) -> DataFrame:
    """softmax(ln(p + 1e-10) / T); T = 1 and T <= 0 change nothing."""
    if temperature == 1.0 or temperature <= 0:
        return scored
    logit = F.log(F.col("p") + F.lit(LOG_FLOOR)) / F.lit(temperature)
    top = F.max("_logit").over(W.partitionBy(*ctx))
    raised = scored.withColumn("_logit", logit).withColumn("p", F.exp(F.col("_logit") - top)).drop("_logit")
    return _renormalised(raised, ctx)


def pick_greedy(scored: DataFrame, ctx: Sequence[str] = ("ctx_id",)) -> DataFrame:
    """The most likely token per context, the lowest ID on ties."""
    best = F.max_by("token_id", F.struct(F.col("p"), -F.col("token_id")))
    return scored.groupBy(*ctx).agg(best.alias("token_id"), F.max("p").alias("p"))


def filter_top_k(scored: DataFrame, k: int = TOP_K, ctx: Sequence[str] = ("ctx_id",)) -> DataFrame:
    """The ``k`` most likely tokens per context, ties by ID, renormalised."""
    kept = scored.withColumn("_rank", F.row_number().over(_best_first(ctx))).where(F.col("_rank") <= k)
    return _renormalised(kept.drop("_rank"), ctx)


def filter_top_p(scored: DataFrame, p: float = TOP_P, ctx: Sequence[str] = ("ctx_id",)) -> DataFrame:
    """Tokens while the running sum, most likely first, stays at or below ``p``; at least one.

    The token that crosses ``p`` is left out.
    """
    order = _best_first(ctx)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    ranked = scored.select("*", F.row_number().over(order).alias("_rank"), F.sum("p").over(upto).alias("_cum"))
    kept = ranked.where((F.col("_cum") <= F.lit(p)) | (F.col("_rank") == 1)).drop("_rank", "_cum")
    return _renormalised(kept, ctx)


def draw(
    scored: DataFrame,
    seed: int = 42,
    step: int = 0,
    n_samples: int = 1,
    ctx: Sequence[str] = ("ctx_id",),
) -> DataFrame:
    """``n_samples`` weighted draws per context, reproducible for a seed.

    The token drawn is the first, by ID, whose running sum exceeds a number that
    depends only on seed, context, step and sample. The number of the draw is in
    ``sample_idx``, or in ``draw_idx`` where the context has a column of that name.
    """
    name = "draw_idx" if "sample_idx" in ctx else "sample_idx"
    upto = W.partitionBy(*ctx).orderBy("token_id").rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy(*ctx)
    steps = scored.select(
        *ctx, "token_id", (F.sum("p").over(upto) / F.sum("p").over(everything)).alias("_cum")
    )
    samples = F.array(*[F.lit(i) for i in range(n_samples)]) if n_samples <= 16 else F.sequence(F.lit(0), F.lit(n_samples - 1))
    rows = steps.withColumn(name, F.explode(samples))
    rows = rows.withColumn("_u", unit_draw(seed, *ctx, F.lit(step), F.col(name)))
    hit = F.min(F.when(F.col("_cum") > F.col("_u"), F.col("token_id")))
    # Rounding may leave the last sum just below 1.
    return rows.groupBy(*ctx, name).agg(F.coalesce(hit, F.max("token_id")).alias("token_id"))


def restricted(
    scored: DataFrame,
    method: str,
    top_k: int = TOP_K,
    top_p: float = TOP_P,
    temperature: float = TEMPERATURE,
    ctx: Sequence[str] = ("ctx_id",),
) -> DataFrame:
    """The tokens a sampling method draws from, with their probabilities."""
    if method not in METHODS or method == "greedy":
        raise ValueError(f"one of {METHODS[1:]} draws, not {method!r}")
    tempered = apply_temperature(scored, temperature, ctx)
    if method == "top_k":
        return filter_top_k(tempered, top_k, ctx)
    return filter_top_p(tempered, top_p, ctx) if method == "top_p" else tempered


def sample_tokens(
    scored: DataFrame,
    method: str = "greedy",
    top_k: int = TOP_K,
    top_p: float = TOP_P,
    temperature: float = TEMPERATURE,
    seed: int = 42,
    step: int = 0,
    ctx: Sequence[str] = ("ctx_id",),
) -> DataFrame:
    """One token per context by the named rule."""
    if method == "greedy":
        return pick_greedy(scored, ctx).select(*ctx, "token_id")
    kept = restricted(scored, method, top_k, top_p, temperature, ctx)
    return draw(kept, seed, step, 1, ctx).select(*ctx, "token_id")


def cumulative_arrays(scored: DataFrame, ctx: Sequence[str] = ("ctx_id",)) -> DataFrame:
    """(ctx..., ids, cum): per context its tokens by ID, and their running shares of the sum.

    One row per context, no longer than the vocabulary.
    """
    upto = W.partitionBy(*ctx).orderBy("token_id").rowsBetween(W.unboundedPreceding, 0)
    share = F.sum("p").over(upto) / F.sum("p").over(W.partitionBy(*ctx))
    steps = scored.select(*ctx, F.struct(F.col("token_id").alias("id"), share.alias("cum")).alias("_step"))
    placed = steps.groupBy(*ctx).agg(F.sort_array(F.collect_list("_step")).alias("_steps"))
    return placed.select(*ctx, F.col("_steps.id").alias("ids"), F.col("_steps.cum").alias("cum"))


def pick_from_arrays(ids: Column, cum: Column, u: Column) -> Column:
    """The first token whose running share exceeds ``u``, by binary search; the last one where rounding leaves none."""
    n = F.size(ids)
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int"))
    whole = F.struct(F.lit(0).alias("low"), n.alias("high"))

    def halve(span: Column, _: Column) -> Column:
        low, high = span["low"], span["high"]
        middle = F.shiftright(low + high, 1)
        right = F.get(cum, middle) <= u
        return F.when(low >= high, span).otherwise(
            F.struct(
                F.when(right, middle + 1).otherwise(low).alias("low"), F.when(right, high).otherwise(middle).alias("high")
            )
        )

    place = F.aggregate(halvings, whole, halve)["low"]
    return F.when(n > 0, F.get(ids, F.least(place, n - 1)))


def samples_per_prompt(prompts: DataFrame, num_samples: int = 1) -> DataFrame:
    """Every prompt ``num_samples`` times, with ``sample_idx``."""
    return prompts.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))))
