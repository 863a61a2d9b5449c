"""Seeded hash keys: a reproducible stand-in for random permutations and draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int, *parts: Column | str) -> Column:
    """32 hex digits that depend only on the seed and the parts, not on the cluster."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def unit_draw(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the key."""
    head = F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)
