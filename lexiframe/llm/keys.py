"""Null ids on their way through Python, where a column of longs with nulls would turn into floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ID = 2**63 - 1


def present(name: str) -> Column:
    """The id, or NO_ID for null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def original(name: str) -> Column:
    """The id as it was."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)
