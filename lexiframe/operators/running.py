"""Running totals inside groups of any size.

A window partitioned by a hot key puts the whole group in one task. Here a group
is cut into blocks of its order column; running values inside a block are added to
what the blocks before it hold. Blocks are again grouped into blocks until the range
of the order column is used up, so that no window holds more than ``block`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _carried(df: DataFrame, group: list[str], order: str, values: list[str], block: int, levels: int) -> DataFrame:
    """Per row of ``df``: the sums of ``values`` over the rows before it, as ``_before_<value>``."""
    keys = list(group)
    if levels > 0:
        df = df.withColumn("_up", F.floor(F.col(order) / F.lit(block)))
        keys.append("_up")
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = df.select("*", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values])
    if levels == 0:
        return local
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    above = _carried(totals.withColumnRenamed("_up", "_at"), group, "_at", values, block, levels - 1)
    above = above.select(*group, F.col("_at").alias("_up"), *[F.col(f"_before_{v}").alias(f"_above_{v}") for v in values])
    joined = local.join(above, keys)
    for v in values:
        joined = joined.withColumn(f"_before_{v}", F.col(f"_before_{v}") + F.col(f"_above_{v}")).drop(f"_above_{v}")
    return joined.drop("_up")


def levels_for(df: DataFrame, order: str, block: int = BLOCK) -> int:
    """How often blocks must be grouped so that no window holds more than ``block`` rows."""
    if block < 3:
        raise ValueError("block must be at least 3")
    span = df.agg((F.max(order) - F.min(order) + 1).alias("span")).first()["span"] or 1
    levels = 0
    while span > block:
        span = -(-span // block) + 1
        levels += 1
    return levels


def running_sums(
    df: DataFrame,
    group: list[str],
    order: str,
    sums: dict[str, str],
    block: int = BLOCK,
    levels: int | None = None,
) -> DataFrame:
    """Add inclusive running sums: ``sums`` maps the new column to the summed one.

    ``order`` is a whole number, unique in the group, such as a turn number. Without
    ``levels`` its range is looked up first.
    """
    if levels is None:
        levels = levels_for(df, order, block)
    values = sorted(set(sums.values()))
    out = _carried(df, group, order, values, block, levels)
    for name, value in sums.items():
        out = out.withColumn(name, F.col(f"_before_{value}") + F.col(value))
    return out.drop(*[f"_before_{v}" for v in values])
