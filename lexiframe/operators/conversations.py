"""Rolling contexts of conversations: (conv_id, turn, role, text), turns numbered in order.

A conversation may be of any length. Session numbers and token positions come from
block-wise running sums, and a context is gathered from blocks of L token positions,
so no task ever holds a whole conversation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.ids import BOS, EOS, last_ids
from lexiframe.functions.text import strip
from lexiframe.operators.encoding import encode
from lexiframe.operators.running import BLOCK, levels_for, running_sums

# What a user types to end or restart a conversation.
EXIT_WORDS = ["exit", "quit", ":q"]
RESET_WORD = "reset"

GROUP = ["conv_id", "session_id"]


def typed_reset(text: str = "text") -> Column:
    return F.lower(strip(F.col(text))) == RESET_WORD


def typed_exit(text: str = "text") -> Column:
    return F.lower(strip(F.col(text))).isin(EXIT_WORDS)


def mark_turns(turns: DataFrame, is_reset: Column | None = None, is_exit: Column | None = None) -> DataFrame:
    """Add 0/1 columns ``_reset``, ``_exit`` and ``_said`` (a turn that adds to the context)."""
    leave = typed_exit() if is_exit is None else is_exit
    restart = ~leave & (typed_reset() if is_reset is None else is_reset)
    said = ~leave & ~restart & (F.length(strip(F.col("text"))) > 0)
    flags = {"_exit": leave, "_reset": restart, "_said": said}
    return turns.select("*", *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in flags.items()])


def number_sessions(marked: DataFrame, block: int = BLOCK, levels: int | None = None) -> DataFrame:
    """Add ``session_id``, the resets so far, and ``_exits``, the exits so far."""
    return running_sums(marked, ["conv_id"], "turn", {"session_id": "_reset", "_exits": "_exit"}, block, levels)


def conversation_sessions(
    turns: DataFrame,
    is_reset: Column | None = None,
    is_exit: Column | None = None,
    block: int = BLOCK,
    levels: int | None = None,
) -> DataFrame:
    """Turns that count, with ``session_id``.

    A reset starts a new session and is dropped, as are blank turns and everything
    from the first exit on.
    """
    numbered = number_sessions(mark_turns(turns, is_reset, is_exit), block, levels)
    kept = numbered.where((F.col("_exits") == 0) & (F.col("_said") == 1))
    return kept.select(*turns.columns, "session_id")


def encode_turns(sessions: DataFrame, vocab: DataFrame, eos_roles: Sequence[str] = ()) -> DataFrame:
    """Token IDs per turn; turns of ``eos_roles`` (generated replies) end with EOS."""
    rows = encode(sessions, vocab, ("conv_id", "turn"), keep=("role", "session_id"))
    if eos_roles:
        ended = F.concat("ids", F.array(F.lit(EOS)))
        rows = rows.withColumn("ids", F.when(F.col("role").isin(list(eos_roles)), ended).otherwise(F.col("ids")))
    return rows.withColumn("n_tokens", F.size("ids").cast("long"))


def _with_totals(rows: DataFrame, context_length: int, block: int, levels: int | None) -> DataFrame:
    """Add the token counts of the session so far; BOS is the one before the first."""
    counted = running_sums(rows, GROUP, "turn", {"_end": "n_tokens"}, block, levels)
    total = F.col("_end") + 1
    return counted.select(
        "*",
        total.alias("total_tokens"),
        F.lit(context_length).alias("context_window"),
        F.least(total, F.lit(context_length)).cast("long").alias("effective_context"),
        (total > context_length).alias("truncated"),
    )


def gather_contexts(
    rows: DataFrame, context_length: int, block: int = BLOCK, levels: int | None = None
) -> DataFrame:
    """Add ``ctx``: the last L IDs of BOS and everything said so far in the session.

    Tokens have positions 1, 2, ... in their session. A context ends at the last
    position of its turn, so with k = end div L it lies in the positions of blocks
    k-1 and k. Every turn puts its last L tokens into the two blocks (at most) they
    touch; a context reads one gathered row of at most 2 L tokens.
    """
    length = context_length
    counted = _with_totals(rows, length, block, levels)

    tail = last_ids(F.col("ids"), length)
    pieces = counted.where(F.size("ids") > 0).select(
        *GROUP, tail.alias("_tail"), "_end", (F.col("_end") - F.size(tail) + 1).alias("_from")
    )
    first, last = F.expr(f"_from div {length}"), F.expr(f"_end div {length} + 1")
    pieces = pieces.withColumn("_k", F.explode(F.sequence(first, last)))
    low = F.greatest("_from", (F.col("_k") - 1) * length)
    high = F.least("_end", (F.col("_k") + 1) * length - 1)
    part = F.slice("_tail", (low - F.col("_from") + 1).cast("int"), (high - low + 1).cast("int"))
    blocks = (
        pieces.where(low <= high)
        .groupBy(*GROUP, "_k")
        .agg(F.sort_array(F.collect_list(F.struct(low.alias("low"), part.alias("ids")))).alias("_parts"))
    )

    ends = counted.withColumn("_k", F.expr(f"_end div {length}"))
    joined = ends.join(blocks, [*GROUP, "_k"], "left")
    lowest = F.greatest(F.col("_end") - (length - 1), F.lit(1))

    def seen(piece: Column) -> Column:
        start = F.greatest(piece["low"], lowest)
        stop = F.least(piece["low"] + F.size(piece["ids"]) - 1, F.col("_end"))
        return F.slice(
            piece["ids"], (start - piece["low"] + 1).cast("int"), F.greatest(stop - start + 1, F.lit(0)).cast("int")
        )

    none = F.array().cast("array<int>")
    said = F.coalesce(F.flatten(F.transform("_parts", seen)), none)
    opening = F.when(F.col("_end") < length, F.array(F.lit(BOS))).otherwise(none)
    return joined.withColumn("ctx", F.concat(opening, said)).drop("_k", "_parts")


def conversation_stats(
    turns: DataFrame,
    vocab: DataFrame,
    context_length: int,
    is_reset: Column | None = None,
    is_exit: Column | None = None,
    eos_roles: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Tokens so far (BOS included), window, effective context and whether it is cut, per turn."""
    levels = levels_for(turns, "turn", block)
    rows = encode_turns(conversation_sessions(turns, is_reset, is_exit, block, levels), vocab, eos_roles)
    return _with_totals(rows, context_length, block, levels).select(
        "conv_id", "session_id", "turn", "role", "total_tokens", "context_window", "effective_context", "truncated"
    )


def rolling_context(
    turns: DataFrame,
    vocab: DataFrame,
    context_length: int,
    is_reset: Column | None = None,
    is_exit: Column | None = None,
    eos_roles: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """The statistics of ``conversation_stats`` and the context itself, per turn."""
    levels = levels_for(turns, "turn", block)
    rows = encode_turns(conversation_sessions(turns, is_reset, is_exit, block, levels), vocab, eos_roles)
    return gather_contexts(rows, context_length, block, levels).select(
        "conv_id", "session_id", "turn", "role", "ctx",
        "total_tokens", "context_window", "effective_context", "truncated",
    )
