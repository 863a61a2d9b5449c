"""Word vectors in text form: one line ``word v1 ... vD``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.functions.text import WHITESPACE_CLASS, strip
from lexiframe.sources.corpus import numbered_lines

# Fixed value: a line needs more fields than this.
MIN_FIELDS = 2


def read_text_embeddings(
    spark: SparkSession,
    path: str,
    max_vocab: int | None = None,
    skip_invalid: bool = True,
    dim: int | None = None,
) -> DataFrame:
    """(token, vec array<float>); the last line of a repeated word counts.

    ``max_vocab`` counts raw lines. A line with a field that is no number is left out,
    or raises when ``skip_invalid`` is off. ``dim`` checks the width.
    """
    lines = numbered_lines(spark, path)
    if max_vocab:
        lines = lines.where(F.col("line_no") < max_vocab)
    fields = lines.select("file", "line_no", F.split(strip(F.col("value")), f"{WHITESPACE_CLASS}+").alias("f"))
    fields = fields.where(F.size("f") > MIN_FIELDS)
    numbers = F.slice("f", F.lit(2), F.size("f") - 1)
    if skip_invalid:
        vec = F.transform(numbers, lambda x: x.try_cast("float"))
        rows = fields.select("file", "line_no", F.col("f")[0].alias("token"), vec.alias("vec"))
        rows = rows.where(~F.exists("vec", lambda x: x.isNull()))
    else:
        vec = F.transform(numbers, lambda x: x.cast("float"))
        rows = fields.select("file", "line_no", F.col("f")[0].alias("token"), vec.alias("vec"))
    latest = rows.groupBy("token").agg(F.max_by("vec", F.struct("file", "line_no")).alias("vec"))
    if dim is not None:
        width = latest.agg(F.max(F.size("vec")).alias("most"), F.min(F.size("vec")).alias("least")).first()
        if width["most"] is None:
            raise ValueError(f"there are no word vectors in {path}")
        if (width["least"], width["most"]) != (dim, dim):
            raise ValueError(f"vectors have {width['least']} to {width['most']} components, not {dim}")
    return latest
