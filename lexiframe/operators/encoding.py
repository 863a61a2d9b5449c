"""Text to token IDs and back.

Both directions explode a row, look every element up by an equi-join with the
vocabulary and gather the row again. The input is partitioned by its key first,
while it is still text; explode and broadcast join keep that partitioning,
so that gathering needs no second shuffle. Of a vocabulary too large to broadcast its most
frequent words are, and only elements they do not answer travel (``lookup``).

``encode`` with ``in_tasks`` needs no exploded rows: a task looks the words of a text up as
it splits it, and only IDs travel. That is for vocabularies small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from lexiframe.functions.ids import SPECIAL_TOKENS, UNK, truncate_ids, wrap_bos_eos
from lexiframe.functions.text import split_words, tokenize
from lexiframe.operators.lookup import HEAD_BYTES, look_up_elements, split_head
from lexiframe.session import partition_by


def _word_ids(vocab: DataFrame, head_bytes: int) -> dict[bytes, int] | None:
    """The vocabulary by word; None when it is larger than ``head_bytes``, or its words are not unique."""
    types = vocab.schema
    if not isinstance(types["token"].dataType, StringType) or not isinstance(types["id"].dataType, IntegerType):
        return None
    head, tail = split_head(vocab.select("token", "id"), "id", head_bytes)
    if tail is not None:
        return None
    table = head.where(F.col("token").isNotNull()).toArrow()
    words = table["token"].cast(pa.binary()).to_pylist()
    found = dict(zip(words, table["id"].fill_null(UNK).to_pylist()))
    return found if len(found) == len(words) else None


def _encode_in_tasks(
    df: DataFrame, known: dict[bytes, int], keys: Sequence[str], text: str, lowercase: bool, keep: Sequence[str]
) -> DataFrame:
    """(keys..., keep..., _found); rows with equal keys are one, their IDs put together by position."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array) -> pa.Array:
        find, found, ends = shared.value.get, [np.empty(0, np.int32)], [0]
        for one in texts.cast(pa.binary()):
            words = split_words(one.as_py() or b"")
            found.append(np.fromiter(map(find, words, repeat(UNK)), np.int32, len(words)))
            ends.append(ends[-1] + len(words))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))

    source = F.lower(text) if lowercase else F.col(text).cast("string")
    rows = partition_by(df.select(*keys, *keep, numbers(source).alias("_ids")), *keys)
    rows = rows.groupBy(*keys, *keep).agg(F.collect_list("_ids").alias("_rows"))
    placed = F.transform("_rows", lambda r: F.transform(r, lambda v, i: F.struct(i.alias("_pos"), v.alias("v"))))
    together = F.sort_array(F.flatten(placed))["v"]
    return rows.select(*keys, *keep, F.when(F.size("_rows") == 1, F.get("_rows", F.lit(0))).otherwise(together).alias("_found"))


def encode(
    df: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    add_bos_eos: bool = False,
    max_length: int | None = None,
    lowercase: bool = True,
    tokenizer: Callable[[Column], Column] | None = None,
    keep: Sequence[str] = (),
    ids: str = "ids",
    head_bytes: int = HEAD_BYTES,
    in_tasks: bool = False,
) -> DataFrame:
    """``keys``, ``keep`` and the ``array<int>`` of token IDs; unknown words become UNK.

    ``keys`` identify a row. A text without words gives an empty array. ``in_tasks`` is the quicker way for
    many texts; a vocabulary beyond ``head_bytes``, or a tokenizer, is joined all the same.
    """
    known = _word_ids(vocab, head_bytes) if in_tasks and not tokenizer else None
    if known is not None:
        encoded = _encode_in_tasks(df, known, keys, text, lowercase, keep)
    else:
        words = tokenizer(F.col(text)) if tokenizer else tokenize(F.col(text), lowercase)
        tokens = partition_by(df, *keys).select(*keys, *keep, F.posexplode_outer(words).alias("_pos", "token"))
        encoded = look_up_elements(tokens, vocab, "token", "id", F.lit(UNK), keys, keep, head_bytes=head_bytes)
    value = F.col("_found")
    if add_bos_eos:
        value = wrap_bos_eos(value)
    out = encoded.select(*keys, *keep, value.alias(ids))
    if max_length is not None:
        out = out.withColumn(ids, truncate_ids(F.col(ids), max_length, keep_eos=add_bos_eos))
    return out


def decode(
    df: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    ids: str = "ids",
    skip_special: bool = True,
    keep: Sequence[str] = (),
    text: str = "text",
    head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """Token IDs back to text, joined by single blanks.

    An ID outside the vocabulary reads as UNK, so it vanishes with ``skip_special``.
    """
    elements = partition_by(df, *keys).select(*keys, *keep, F.posexplode_outer(ids).alias("_pos", "id"))
    unknown = F.lit(SPECIAL_TOKENS[UNK])
    decoded = look_up_elements(elements, vocab, "id", "token", unknown, keys, keep, head_bytes=head_bytes)
    special = F.array(*map(F.lit, SPECIAL_TOKENS))
    tokens = F.filter("_found", lambda t: ~F.array_contains(special, t)) if skip_special else F.col("_found")
    return decoded.select(*keys, *keep, F.array_join(tokens, " ").alias(text))
