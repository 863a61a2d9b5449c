"""Column functions on arrays of token IDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special tokens and their IDs.
SPECIAL_TOKENS = ["<PAD>", "<UNK>", "<BOS>", "<EOS>"]
PAD, UNK, BOS, EOS = 0, 1, 2, 3


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def wrap_bos_eos(ids: Column) -> Column:
    return F.concat(_ints(BOS), ids, _ints(EOS))


def truncate_ids(ids: Column, max_length: int, keep_eos: bool = False) -> Column:
    """At most ``max_length`` IDs; with ``keep_eos`` the last kept one is EOS."""
    if max_length < 1:
        raise ValueError("max_length must be at least 1")
    if keep_eos:
        cut = _ints(EOS) if max_length == 1 else F.concat(F.slice(ids, 1, max_length - 1), _ints(EOS))
    else:
        cut = F.slice(ids, 1, max_length)
    return F.when(F.size(ids) > max_length, cut).otherwise(ids)


def pad_ids(ids: Column, length: int) -> Column:
    """Exactly ``length`` IDs: PAD on the right, or cut without regard to EOS."""
    if length < 1:
        raise ValueError("length must be at least 1")
    return F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), length)), 1, length)


def left_pad_context(ids: Column, context_length: int) -> Column:
    """The last ``context_length`` IDs, with PAD on the left."""
    if context_length < 1:
        raise ValueError("context_length must be at least 1")
    padded = F.concat(F.array_repeat(F.lit(PAD), context_length), ids)
    return F.slice(padded, -context_length, context_length)


def last_ids(ids: Column, n: int) -> Column:
    """The last ``n`` IDs, or all of them when there are fewer."""
    return F.slice(ids, F.greatest(F.size(ids) - (n - 1), F.lit(1)), F.lit(n))


def context_length(ctx: Column) -> Column:
    """Number of tokens that are not PAD."""
    return F.size(F.array_remove(ctx, PAD))


def unk_count(ctx: Column) -> Column:
    return F.size(ctx) - F.size(F.array_remove(ctx, UNK))


def pad_count(ctx: Column) -> Column:
    return F.size(ctx) - F.size(F.array_remove(ctx, PAD))


def type_token_ratio(ctx: Column) -> Column:
    """Distinct tokens over tokens, PAD left out; 0 for an empty context."""
    tokens = F.array_remove(ctx, PAD)
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(F.lit(0.0))


def last_token(ctx: Column) -> Column:
    """The last token that is not PAD, or null."""
    return F.try_element_at(F.array_remove(ctx, PAD), F.lit(-1))
