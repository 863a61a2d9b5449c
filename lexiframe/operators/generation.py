"""Text generation: all prompts advance together, one scoring job per new token."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.hashing import unit_draw
from lexiframe.functions.ids import BOS, EOS, left_pad_context
from lexiframe.operators.encoding import decode, encode
from lexiframe.operators.next_token import NextTokenModel, predict_proba, suffix, with_known_context
from lexiframe.operators.sampling import (
    METHODS,
    TEMPERATURE,
    TOP_K,
    TOP_P,
    cumulative_arrays,
    pick_from_arrays,
    restricted,
    sample_tokens,
    samples_per_prompt,
)
from lexiframe.session import discard, materialize

# Fixed value: default length of a generated text.
MAX_NEW_TOKENS = 50

# From rows with a context (``ctx``) to (keys..., token_id, p).
Scorer = Callable[[DataFrame, Sequence[str]], DataFrame]


# From rows with a context, the number of the step and the keys to (keys..., token_id).
Picker = Callable[[DataFrame, int, Sequence[str]], DataFrame]


class ModelScorer:
    """Scores by a table of next-token probabilities.

    For drawing, the probabilities of each context are tempered, cut and summed up once, so a step
    joins a prompt with one row and searches in its array.
    """

    def __init__(self, model: NextTokenModel):
        self.model = model

    def __call__(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return predict_proba(rows, self.model, keys)

    def picker(self, sampling: str, top_k: int, top_p: float, temperature: float, seed: int) -> Picker:
        if sampling == "greedy":
            best = self.model.heads.select(F.col("ctx").alias("known"), F.col("best").alias("token_id"))
        else:
            # Sorted by a hash first, as numbers are compared much faster than arrays.
            table = self.model.table.withColumn("_hash", F.xxhash64("ctx"))
            kept = restricted(table, sampling, top_k, top_p, temperature, ("_hash", "ctx"))
            arrays = cumulative_arrays(kept, ("_hash", "ctx")).withColumnRenamed("ctx", "known")
            arrays = materialize(arrays, "draws")

        def pick(rows: DataFrame, step: int, keys: Sequence[str]) -> DataFrame:
            if sampling == "greedy":
                known = with_known_context(rows.select(*keys, "ctx"), self.model)
                return known.join(best, "known").select(*keys, "token_id")
            # All suffixes of a context ask at once, so that a step reads the table once; the longest one known counts.
            ctx, order = F.col("ctx").cast("array<int>"), self.model.order
            suffixes = F.array(*[suffix(ctx, length) for length in range(order, -1, -1)])
            asked = rows.select(*keys, F.posexplode(suffixes).alias("_shorter", "known"))
            found = asked.withColumn("_hash", F.xxhash64("known")).join(arrays, ["_hash", "known"])
            u = unit_draw(seed, *keys, F.lit(step), F.lit(0))
            drawn = found.withColumn("_u", u).select(
                *keys, "_shorter", pick_from_arrays(F.col("ids"), F.col("cum"), F.col("_u")).alias("token_id")
            )
            return drawn.groupBy(*keys).agg(F.min_by("token_id", "_shorter").alias("token_id"))

        return pick


def model_scorer(model: NextTokenModel) -> ModelScorer:
    """Scores by a table of next-token probabilities."""
    return ModelScorer(model)


def continue_ids(
    rows: DataFrame,
    scorer: Scorer,
    context_length: int,
    keys: Sequence[str],
    max_new_tokens: int = MAX_NEW_TOKENS,
    sampling: str = "greedy",
    top_k: int = TOP_K,
    top_p: float = TOP_P,
    temperature: float = TEMPERATURE,
    stop_at_eos: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Append up to ``max_new_tokens`` IDs to ``ids``; the new ones are also in ``new_ids``.

    Each step is written to the shared folder, so lineage stays one step long and
    finished rows are not scored again; the copy of the step before is deleted.
    """
    if sampling not in METHODS:
        raise ValueError(f"sampling is one of {METHODS}, not {sampling!r}")
    pick = scorer.picker(sampling, top_k, top_p, temperature, seed) if isinstance(scorer, ModelScorer) else None
    none = F.array().cast("array<int>")
    state = rows.select(*keys, "ids", none.alias("new_ids"), F.lit(False).alias("done"))
    former = None
    for step in range(max_new_tokens):
        state = materialize(state, "generated")
        if former is not None:
            discard(former, shuffles=False)
        former = state
        active = state.where(~F.col("done"))
        if step > 0 and active.isEmpty():
            break
        asked = active.withColumn("ctx", left_pad_context(F.col("ids"), context_length))
        if pick:
            picked = pick(asked, step, keys)
        else:
            picked = sample_tokens(scorer(asked, keys), sampling, top_k, top_p, temperature, seed, step, keys)
        picked = picked.select(*keys, F.col("token_id").cast("int").alias("_next"))
        added = F.when(F.col("_next").isNotNull(), F.array("_next")).otherwise(none)
        ended = F.coalesce(F.col("_next") == EOS, F.lit(False)) & F.lit(stop_at_eos)
        state = state.join(picked, list(keys), "left").select(
            *keys,
            F.concat("ids", added).alias("ids"),
            F.concat("new_ids", added).alias("new_ids"),
            (F.col("done") | ended).alias("done"),
        )
    return state


def generate_batch(
    prompts: DataFrame,
    vocab: DataFrame,
    scorer: Scorer,
    context_length: int,
    num_samples: int = 1,
    **settings,
) -> DataFrame:
    """(prompt_id, sample_idx, prompt, generated) for (prompt_id, prompt); prompt included in the text."""
    keys = ("prompt_id", "sample_idx")
    encoded = encode(prompts, vocab, ("prompt_id",), text="prompt")
    opened = encoded.select("prompt_id", F.concat(F.array(F.lit(BOS)), "ids").alias("ids"))
    rows = continue_ids(samples_per_prompt(opened, num_samples), scorer, context_length, keys, **settings)
    texts = decode(rows, vocab, keys, text="generated")
    return texts.join(prompts.select("prompt_id", "prompt"), "prompt_id").select(
        "prompt_id", "sample_idx", "prompt", "generated"
    )


def generate_replies(
    contexts: DataFrame, vocab: DataFrame, scorer: Scorer, context_length: int, **settings
) -> DataFrame:
    """(conv_id, turn, reply) for rolling contexts: only what was generated, not the context."""
    keys = ("conv_id", "turn")
    rows = continue_ids(contexts.select(*keys, F.col("ctx").alias("ids")), scorer, context_length, keys, **settings)
    return decode(rows, vocab, keys, ids="new_ids", text="reply")
