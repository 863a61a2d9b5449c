"""Equi-lookups in tables whose most frequent keys hold a large share of all rows.

The head of the table, its most frequent entries up to a measured number of bytes, goes to
every task, so the rows that ask for them do not move. Only the others meet the tail by
shuffle, each key spread over several tasks: a key that the table lacks may be frequent too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexiframe.session import materialize

# The head of a table is measured to be no larger than this.
HEAD_BYTES = 32 << 20
# So many tasks share the rows of one key in the tail.
SALTS = 16
ROW_BYTES = 32


def _bytes(table: DataFrame) -> Column:
    """The size of a row, roughly as it lies in memory."""
    size = F.lit(ROW_BYTES)
    for f in table.schema:
        if isinstance(f.dataType, StringType):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            size = size + F.coalesce(F.size(f.name), F.lit(0)) * 8
    return size.cast("long")


def split_head(table: DataFrame, rank: str, head_bytes: int = HEAD_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """(head, tail) of a table whose ``rank`` counts from 0, most frequent first; no tail when all of it fits.

    Ranks may have gaps. The head's size is the sum of its rows' sizes, not an estimate.
    """
    size = F.coalesce(F.sum(_bytes(table)), F.lit(0))
    facts = table.agg(size.alias("bytes"), F.max(rank).alias("last")).first()
    if facts["bytes"] <= head_bytes:
        return table, None
    last, held = facts["last"], facts["bytes"]
    while held > head_bytes:
        last = min(last - 1, last * head_bytes // held)
        held = table.where(F.col(rank) <= last).agg(size).first()[0]
    inside = F.col(rank) <= last
    return table.where(inside), table.where(~F.coalesce(inside, F.lit(False)))


def _salted(rows: DataFrame, table: DataFrame, key: str, salt: Column, salts: int) -> DataFrame:
    """Left join in which the rows of one key are dealt to ``salts`` tasks."""
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(salts))).join(spread, [key, "_salt"], "left").drop("_salt")


def lookup(
    rows: DataFrame, table: DataFrame, key: str, rank: str, head_bytes: int = HEAD_BYTES, salts: int = SALTS
) -> DataFrame:
    """Every row once, with the columns of its entry in ``table(key, ...)``, null where there is none.

    Keys of the table are unique. ``rank`` orders its entries, most frequent first; it is a column of the table.
    """
    head, tail = split_head(table, rank, head_bytes)
    if tail is None:
        return rows.join(F.broadcast(head), key, "left")
    values = [c for c in table.columns if c != key]
    marked = rows.join(F.broadcast(head.withColumn("_hit", F.lit(True))), key, "left")
    names = [*rows.columns, *values]
    missed = marked.where(F.col("_hit").isNull()).select(*rows.columns)
    found = _salted(missed, tail, key, F.xxhash64(*rows.columns), salts)
    return marked.where("_hit").select(*names).unionByName(found.select(*names))


def look_up_elements(
    elements: DataFrame,
    table: DataFrame,
    key: str,
    value: str,
    default: Column,
    keys: Sequence[str],
    keep: Sequence[str] = (),
    rank: str = "id",
    head_bytes: int = HEAD_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """(keys..., keep..., _found): the values of ``elements(keys..., keep..., _pos, key)`` in order, per row.

    ``elements`` are exploded rows, partitioned by ``keys``; a ``_pos`` of null stands for a
    row without elements. What the head answers is gathered where it is; only elements
    it lacks travel, to the tail and back to their row.
    """
    columns = list(dict.fromkeys([key, value, rank]))
    head, tail = split_head(table.select(*columns), rank, head_bytes)
    present = F.col("_pos").isNotNull()
    if tail is None:
        found = elements.join(F.broadcast(head.select(key, F.col(value).alias("_value"))), key, "left")
        element = F.struct("_pos", F.coalesce("_value", default).alias("v"))
        placed = F.sort_array(F.collect_list(F.when(present, element)))
        return found.groupBy(*keys, *keep).agg(placed.alias("_placed")).select(*keys, *keep, F.col("_placed.v").alias("_found"))

    found = elements.join(F.broadcast(head.select(key, F.col(value).alias("_value"), F.lit(True).alias("_hit"))), key, "left")
    asked = F.when(F.col("_hit").isNull(), F.col(key)).alias("asked")
    element = F.struct("_pos", F.coalesce("_value", default).alias("v"), asked, F.col("_hit").alias("hit"))
    placed = F.sort_array(F.collect_list(F.when(present, element)))
    # Written, as it is read for the elements that are missing and again to put them in.
    rows = materialize(found.groupBy(*keys, *keep).agg(placed.alias("_placed")), "looked-up")
    missing = F.explode(F.filter("_placed", lambda e: e["hit"].isNull()))
    asked = rows.select(*keys, missing.alias("_m")).select(*keys, F.col("_m._pos").alias("_pos"), F.col("_m.asked").alias(key))
    answered = _salted(asked, tail.select(key, F.col(value).alias("_value")), key, F.xxhash64(*keys, "_pos"), salts)
    late = F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_value", default).alias("v"))))
    names = [f"_key{i}" for i in range(len(keys))]
    late = answered.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(late.alias("_late"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    both = rows.join(late, same, "left")
    known = F.transform(F.filter("_placed", lambda e: e["hit"]), lambda e: F.struct(e["_pos"].alias("_pos"), e["v"].alias("v")))
    every = F.when(F.col("_late").isNull(), known).otherwise(F.sort_array(F.concat(known, "_late")))
    return both.withColumn("_all", every).select(*keys, *keep, F.col("_all.v").alias("_found"))
