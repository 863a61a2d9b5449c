"""Rolling contexts of a stream of turns.

Each micro-batch is an ordinary batch job over its turns, preceded by one row per
conversation that stands for everything before: session, number of tokens, last L
IDs. That state is a table in the shared folder, so a conversation that fills the
whole micro-batch is still spread over many tasks, and a lost executor loses nothing.

``keep_rolling_context`` does the same with Spark's state store in place of that table: a
conversation's turns of one micro-batch meet in one task, and the store keeps its own files few.

Turns of a conversation must arrive in order from batch to batch; inside a batch any
order will do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiframe.functions.ids import BOS, EOS, UNK
from lexiframe.functions.text import tokenize
from lexiframe.operators.lookup import HEAD_BYTES, split_head
from lexiframe.operators.conversations import GROUP, encode_turns, gather_contexts, mark_turns, number_sessions
from lexiframe.operators.running import BLOCK, levels_for
from lexiframe.session import materialize

STATE_SCHEMA = (
    "conv_id bigint, session_id bigint, exited bigint, last_turn bigint, total_tokens bigint, tail array<int>"
)
# Every so many batches the state is written in full; in between only what changed.
SNAPSHOT_EVERY = 16

OUT = [
    "conv_id", "session_id", "turn", "role", "ctx",
    "total_tokens", "context_window", "effective_context", "truncated",
]


def advance(
    turns: DataFrame,
    states: DataFrame,
    vocab: DataFrame,
    context_length: int,
    is_reset: Column | None = None,
    is_exit: Column | None = None,
    eos_roles: Sequence[str] = (),
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(contexts of the turns, state of their conversations afterwards).

    ``states`` holds state rows with the ``batch`` that wrote them; the latest counts.
    """
    known = _latest(states.join(turns.select("conv_id").distinct(), "conv_id", "left_semi"))
    marked = mark_turns(turns, is_reset, is_exit).withColumn("_past", F.lit(False))
    past = known.select(
        "conv_id",
        F.col("last_turn").alias("turn"),
        F.col("session_id").alias("_reset"),
        F.col("exited").alias("_exit"),
        F.lit(0).cast("long").alias("_said"),
        F.lit(True).alias("_past"),
        "tail",
        (F.col("total_tokens") - 1).alias("_n_past"),
    )
    rows = marked.unionByName(past, allowMissingColumns=True)
    levels = levels_for(rows, "turn", block)
    numbered = materialize(number_sessions(rows, block, levels), "turns")

    said = numbered.where((F.col("_exits") == 0) & (F.col("_said") == 1))
    encoded = encode_turns(said, vocab, eos_roles).withColumn("_past", F.lit(False))
    before = numbered.where("_past").select(
        "conv_id", "turn", "role", "session_id", F.col("tail").alias("ids"), F.col("_n_past").alias("n_tokens"), "_past"
    )
    contexts = materialize(gather_contexts(encoded.unionByName(before), context_length, block, levels), "contexts")

    ends = numbered.groupBy("conv_id").agg(
        F.max("session_id").alias("session_id"),
        F.least(F.max("_exits"), F.lit(1)).alias("exited"),
        F.max("turn").alias("last_turn"),
    )
    newest = contexts.groupBy(*GROUP).agg(F.max_by(F.struct("total_tokens", "ctx"), "turn").alias("_at"))
    after = ends.join(newest, GROUP, "left").select(
        "conv_id",
        "session_id",
        "exited",
        "last_turn",
        F.coalesce("_at.total_tokens", F.lit(1)).alias("total_tokens"),
        F.coalesce(F.array_remove("_at.ctx", BOS), F.array().cast("array<int>")).alias("tail"),
    )
    return contexts.where(~F.col("_past")).select(*OUT), after


def _latest(states: DataFrame) -> DataFrame:
    fields = [c for c in states.columns if c not in ("conv_id", "batch")]
    newest = states.groupBy("conv_id").agg(F.max_by(F.struct(*fields), "batch").alias("s"))
    return newest.select("conv_id", "s.*")


def stream_rolling_context(
    turns: DataFrame,
    vocab: DataFrame,
    context_length: int,
    path: str,
    is_reset: Column | None = None,
    is_exit: Column | None = None,
    eos_roles: Sequence[str] = (),
    block: int = BLOCK,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream; contexts go to ``path``/contexts.

    Every batch writes to folders that carry its number, replacing what an interrupted
    run of the same batch left, so a restart repeats nothing.
    """
    spark = turns.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        schema = f"{STATE_SCHEMA}, batch bigint"
        if batch_id == 0:
            states = spark.createDataFrame([], schema)
        else:
            snapshot = (batch_id - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
            stored = spark.read.schema(schema).parquet(f"{path}/state")
            states = stored.where((F.col("batch") >= snapshot) & (F.col("batch") < batch_id))
        contexts, after = advance(batch, states, vocab, context_length, is_reset, is_exit, eos_roles, block)
        if batch_id % SNAPSHOT_EVERY == 0:
            after = materialize(after, "state")
            after = after.unionByName(_latest(states.join(after, "conv_id", "left_anti")))
        contexts.write.mode("overwrite").parquet(f"{path}/contexts/batch={batch_id}")
        after.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")

    writer = turns.writeStream.foreachBatch(process).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


KEPT_STATE = "session_id long, exited boolean, total_tokens long, tail array<int>"
KEPT_OUT = (
    "conv_id long, session_id long, turn long, role string, ctx array<int>, "
    "total_tokens long, context_window int, effective_context long, truncated boolean"
)


def keep_rolling_context(
    turns: DataFrame,
    vocab: DataFrame,
    context_length: int,
    path: str,
    is_reset: Column | None = None,
    is_exit: Column | None = None,
    eos_roles: Sequence[str] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream with the state in Spark's store; contexts go to ``path``/contexts.

    A conversation's state is its session, whether it was left, its number of tokens and
    the last ``context_length`` IDs. The vocabulary goes to the tasks, so it must be of a
    bounded size: a larger one is an error, and ``stream_rolling_context`` takes it. What is
    held of a micro-batch is one conversation's turns. How many old versions of the state stay is
    Spark's setting ``spark.sql.streaming.minBatchesToRetain``.
    """
    if split_head(vocab.select("id", "token"), "id")[1] is not None:
        raise ValueError(f"the vocabulary is larger than {HEAD_BYTES} bytes")
    spark = turns.sparkSession
    words = spark.sparkContext.broadcast({r["token"]: r["id"] for r in vocab.select("token", "id").collect()})
    ends = frozenset(eos_roles)
    kinds = dict(turns.dtypes)
    marked = mark_turns(turns, is_reset, is_exit).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "_exit", "_reset", "_said", tokenize(F.col("text")).alias("_words")
    )

    def advance_one(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        session, exited, total, tail = state.get if state.exists else (0, False, 1, [BOS])
        tail, rows = list(tail), []
        for turn in pd.concat(list(batches)).sort_values("turn", kind="stable").itertuples(index=False, name=None):
            _, number, role, leaves, resets, said, spoken = turn
            if exited or leaves:
                exited = True
                continue
            if resets:
                session, total, tail = session + 1, 1, [BOS]
            if not said:
                continue
            ids = [words.value.get(w, UNK) for w in spoken] + ([EOS] if role in ends else [])
            total, tail = total + len(ids), (tail + ids)[-context_length:]
            rows.append((key[0], session, number, role, tail, total, context_length, min(total, context_length), total > context_length))
        state.update((session, exited, total, [int(i) for i in tail]))
        names = [f.split()[0] for f in KEPT_OUT.split(", ")]
        yield pd.DataFrame(rows, columns=names).assign(ctx=pd.Series([np.array(r[4], np.int32) for r in rows], dtype=object))

    contexts = marked.groupBy("conv_id").applyInPandasWithState(
        advance_one, KEPT_OUT, KEPT_STATE, "append", GroupStateTimeout.NoTimeout
    )
    types = {"conv_id": kinds["conv_id"], "turn": kinds["turn"]}
    contexts = contexts.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in OUT])
    writer = contexts.writeStream.format("parquet").option("path", f"{path}/contexts").option("checkpointLocation", f"{path}/checkpoint")
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
