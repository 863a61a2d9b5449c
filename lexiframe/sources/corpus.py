"""Readers for text corpora.

A corpus has a dense ``doc_id`` in file order. Row order inside one input split is
known from the scan; the place of a split comes from a small table with one row per
split, so numbering moves no text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiframe.functions.text import WHITESPACE, chunk_starts, drop_invalid_utf8, strip
from lexiframe.operators.ranking import take_first
from lexiframe.session import materialize
from lexiframe.sources import stitching

# Defaults of the corpus readers.
MIN_DOC_LENGTH = 10
MIN_LINE_LENGTH = 10
MIN_PARAGRAPHS = 10
TEXT_COLUMN = "text"

# What pandas reads as a missing value in a CSV file.
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a table that is read by fewer tasks than the session has cores.

    One small Parquet file is one task, and every step after it would be too. A large
    table has more splits than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def _scan(spark: SparkSession, path: str, line_sep: str | None = None) -> tuple[DataFrame, list[str]]:
    """Text records with file and split offset; also the names of partition columns."""
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    raw = reader.text(path)
    extra = [c for c in raw.columns if c != "value"]
    records = raw.select(
        drop_invalid_utf8(F.col("value")).alias("value"),
        *extra,
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
    )
    return records, extra


def _numbered(rows: DataFrame, name: str, per_file: bool = False) -> DataFrame:
    """Number rows from 0 in (file, split, ``_seq``) order.

    ``_seq`` increases inside a split without a gap. The window runs over one row per
    input split.
    """
    splits = rows.groupBy("file", "_split").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    scope = W.partitionBy("file").orderBy("_split") if per_file else W.orderBy("file", "_split")
    before = F.coalesce(F.sum("_n").over(scope.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(splits.select("file", "_split", "_first", before.alias("_start")), "splits")
    placed = rows.join(starts, ["file", "_split"])
    return placed.withColumn(name, F.col("_start") + F.col("_seq") - F.col("_first")).drop(
        "_split", "_seq", "_first", "_start"
    )


def _with_seq(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_seq", F.monotonically_increasing_id())


def _blank_breaks(lines: pa.RecordBatch, opened: bool | None) -> stitching.Marks:
    """Blank lines separate paragraphs."""
    member = ~lines.column(lines.schema.get_field_index("_blank")).to_numpy(zero_copy_only=False)
    before = np.concatenate([[bool(opened)], member[:-1]])
    return member, member & ~before, bool(member[-1]), False


def _paragraphs(spark: SparkSession, path: str, min_doc_length: int) -> stitching.Units:
    records, extra = _scan(spark, path)
    lines = records.select("file", "_split", *extra, "value", (F.length(strip(F.col("value"))) == 0).alias("_blank"))
    made = stitching.assemble(lines, extra, _blank_breaks)
    return stitching.units(made, extra, strip, lambda text: F.length(text) > min_doc_length)


def _long_edges(found: stitching.Units, min_doc_length: int) -> DataFrame:
    """Paragraphs in pieces that are long enough, by the lengths of their pieces: no text is put together.

    Only the white space around the first and the last line counts less, as no line is blank.
    """
    place = F.struct("_split", "_order")
    n = F.length("value")
    ends = found.pieces.groupBy("file", "_unit").agg(
        F.sum(n + 1).alias("_chars"),
        F.min_by(n - F.length(F.ltrim("value", F.lit(WHITESPACE))), place).alias("_lead"),
        F.max_by(n - F.length(F.rtrim("value", F.lit(WHITESPACE))), place).alias("_trail"),
    )
    long = ends.where(F.col("_chars") - 1 - F.col("_lead") - F.col("_trail") > min_doc_length)
    return found.edges.join(long.select("file", "_unit"), ["file", "_unit"], "left_semi")


def _in_corpus_order(sizes: DataFrame) -> DataFrame:
    """(file, _split, _start) from the number of documents per split; the window runs over one row per split."""
    before = W.orderBy("file", "_split").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("file", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return materialize(starts, "starts")


def _whole_paragraphs(found: stitching.Units, edges: DataFrame) -> DataFrame:
    """The text of the units in ``edges``, put together from their pieces."""
    chosen = found.pieces.join(edges.select("file", "_unit"), ["file", "_unit"], "left_semi")
    joined = stitching.joined_pieces(chosen, found.extra, strip)
    return joined.join(edges.select("file", "_unit", "_split", "_local"), ["file", "_unit"])


def _documents(found: stitching.Units, joined: DataFrame, sizes: DataFrame, starts: DataFrame) -> DataFrame:
    """Units inside a split and those put together, with a dense ``doc_id`` in corpus order."""
    names = ["file", "_split", *found.extra, "text", "_local"]
    heads = sizes.select("file", "_split", "_heads")
    whole = found.whole.join(heads, ["file", "_split"]).withColumn("_local", F.col("_local") + F.col("_heads"))
    placed = whole.select(*names).unionByName(joined.select(*names)).join(starts, ["file", "_split"])
    return placed.select((F.col("_start") + F.col("_local")).alias("doc_id"), "text", "file", *found.extra)


def read_paragraphs(
    spark: SparkSession, path: str, min_doc_length: int = MIN_DOC_LENGTH, line_sep: str | None = None
) -> DataFrame:
    """Paragraphs separated by blank lines, longer than ``min_doc_length`` characters.

    Files are read by lines, a large one by many tasks whatever its line ends are; a
    paragraph that reaches over the edge of a split is put together from its pieces.
    A single paragraph is one row and so limited to 2 GB. ``line_sep`` is no longer needed.
    """
    found = _paragraphs(spark, path, min_doc_length)
    edges, sizes = stitching.local_places(_long_edges(found, min_doc_length), found)
    return _documents(found, _whole_paragraphs(found, edges), sizes, _in_corpus_order(sizes))


def read_paragraphs_or_lines(
    spark: SparkSession,
    path: str,
    min_doc_length: int = MIN_DOC_LENGTH,
    min_paragraphs: int = MIN_PARAGRAPHS,
    line_sep: str | None = None,
    unit: str = "file",
) -> DataFrame:
    """Paragraphs, but single lines where a file has fewer than ``min_paragraphs`` of them.

    ``unit="directory"`` decides for all files of a directory together, for corpora
    kept as a directory of part files. A file without blank lines is never put together:
    the lengths of its pieces tell how many paragraphs it has.
    """
    unit_of = F.col("file") if unit == "file" else F.regexp_replace("file", "/[^/]*$", "")
    found = _paragraphs(spark, path, min_doc_length)
    edges, sizes = stitching.local_places(_long_edges(found, min_doc_length), found)
    per_unit = sizes.groupBy(unit_of.alias("_unit_of")).agg(F.sum("_n").alias("_n"))
    few = materialize(per_unit.where(F.col("_n") < min_paragraphs).select("_unit_of"), "few")
    if few.isEmpty():
        return _documents(found, _whole_paragraphs(found, edges), sizes, _in_corpus_order(sizes))

    def of(rows: DataFrame, how: str) -> DataFrame:
        return rows.withColumn("_unit_of", unit_of).join(few, "_unit_of", how).drop("_unit_of")

    records, extra = _scan(spark, path)
    lines = records.select("file", "_split", *extra, strip(F.col("value")).alias("text"))
    lines = of(_with_seq(lines.where(F.length("text") > min_doc_length)), "left_semi")
    of_lines = lines.groupBy("file", "_split").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_lines = materialize(of_lines, "splits")
    of_units, edges = of(sizes, "left_anti"), of(edges, "left_anti")
    starts = _in_corpus_order(of_units.select("file", "_split", "_n").unionByName(of_lines.drop("_first")))
    placed = lines.join(of_lines.drop("_n"), ["file", "_split"]).join(starts, ["file", "_split"])
    singles = placed.select((F.col("_start") + F.col("_seq") - F.col("_first")).alias("doc_id"), "text", "file", *extra)
    return _documents(found, _whole_paragraphs(found, edges), of_units, starts).unionByName(singles)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 0, value) for every raw line."""
    records, extra = _scan(spark, path)
    return _numbered(_with_seq(records), "line_no", per_file=True).select("file", *extra, "line_no", "value")


def read_lines(
    spark: SparkSession,
    path: str,
    max_lines: int | None = None,
    min_line_length: int = MIN_LINE_LENGTH,
) -> DataFrame:
    """Stripped lines of at least ``min_line_length`` characters.

    ``max_lines`` counts raw lines of each file, before the length filter.
    """
    lines = numbered_lines(spark, path)
    if max_lines is not None:
        lines = lines.where(F.col("line_no") < max_lines)
    lines = lines.withColumn("text", strip(F.col("value"))).where(F.length("text") >= min_line_length)
    return lines.drop("value")


_QUOTES = re.compile('"+')


def _well_formed(line: str, opened: bool) -> bool:
    """Whether quotes only open a value at its beginning and close it at its end."""
    for run in _QUOTES.finditer(line):
        a, b = run.span()
        starts, ends = a == 0 or line[a - 1] == ",", b == len(line) or line[b] == ","
        if (b - a) % 2:
            if not (ends if opened else starts):
                return False
            opened = not opened
        elif not opened and starts and not ends:
            return False
    return True


def _record_ends(lines: pa.RecordBatch, opened: bool | None) -> stitching.Marks:
    """A record ends with the line after which the number of quotes is even; blank lines between records are none."""
    quotes = lines.column(lines.schema.get_field_index("_quotes")).to_numpy()
    if opened is None:
        opened = lines.column(lines.schema.get_field_index("_odd"))[0].as_py()
    after = (np.cumsum(quotes) + int(opened)) % 2 == 1
    before = np.concatenate([[opened], after[:-1]])
    values = lines.column(lines.schema.get_field_index("value"))
    quoted = np.flatnonzero(quotes)
    texts = values.take(pa.array(quoted)).to_pylist()
    fine = all(_well_formed(text.removesuffix("\r"), bool(before[i])) for i, text in zip(quoted, texts))
    empty = pc.is_in(values, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
    member = before | ~empty
    return member, member & ~before, bool(after[-1]), not fine


def _csv_reader(spark: SparkSession, paths: str | list[str], multi_line: bool) -> DataFrame:
    return spark.read.csv(paths, header=True, multiLine=multi_line, escape='"', nullValue="")


def _is_text(text: Column) -> Column:
    return text.isNotNull() & ~text.isin(CSV_NULLS)


def _csv_values(raw: DataFrame, text_column: str) -> DataFrame:
    """(file, _split, text, _seq) of rows as Spark's reader gives them."""
    rows = raw.select(
        F.col(f"`{text_column}`").cast("string").alias("text"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
    )
    return _with_seq(rows.where(_is_text(F.col("text"))))


def read_csv_texts(
    spark: SparkSession,
    path: str,
    text_column: str = TEXT_COLUMN,
    multi_line: bool = True,
) -> DataFrame:
    """One text column of CSV files, without missing values and without a length filter.

    Values stay the text they are in the file, line breaks in quotes included. A large file
    is read by many tasks: whether a split begins inside a quoted value follows from the
    number of quotes before it, summed over one row per split, and records that reach over
    an edge are put together. Files in which quotes or line ends do not follow the format
    (a quote inside an unquoted value, several kinds of line ends) are read by one task
    each, as Spark's reader reads them. ``multi_line=False`` takes every line for a record.
    """
    raw = _csv_reader(spark, path, multi_line)
    if not raw.columns:
        raise ValueError(f"no header line in the CSV input {path}")
    if text_column not in raw.columns:
        raise ValueError(f"the CSV input has no column '{text_column}' but {raw.columns}")
    if not multi_line:
        return _numbered(_csv_values(raw, text_column), "doc_id").select("doc_id", "text", "file")

    records = spark.read.option("lineSep", "\n").text(path)
    partitions = {c for c in records.columns if c != "value"}
    value = F.make_valid_utf8(F.col("value"))
    records = records.select(
        value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split")
    ).withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    splits = records.groupBy("file", "_split").agg(
        (F.sum("_quotes") % 2).alias("_odd"),
        F.count(F.lit(1)).alias("_lines"),
        F.count(F.when(F.col("value").endswith("\r"), 1)).alias("_returns"),
        F.count(F.when(F.locate("\r", F.col("value")).between(1, F.length("value") - 1), 1)).alias("_lone"),
    )
    splits = materialize(splits, "quotes")
    before = W.partitionBy("file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    odd = splits.select("file", "_split", (F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2 == 1).alias("_odd"))
    # One row per split of the input; a broadcast leaves the lines in the order of the scan.
    lines = records.join(F.broadcast(odd), ["file", "_split"])

    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in raw.columns if c not in partitions)
    options = {"multiLine": "true", "escape": '"', "nullValue": ""}

    def parsed(record: Column) -> Column:
        return F.from_csv(F.regexp_replace(record, "\r$", ""), fields, options)[text_column]

    made = stitching.assemble(lines, [], _record_ends)
    found = stitching.units(made, [], parsed, _is_text)
    ends = splits.groupBy("file").agg(F.sum("_lines").alias("n"), F.sum("_returns").alias("r"), F.sum("_lone").alias("lone"))
    mixed = ends.where((F.col("lone") > 0) | ((F.col("r") > 0) & (F.col("r") < F.col("n") - 1))).select("file")
    odd_files = materialize(mixed.union(found.splits.where("_broken").select("file")).distinct(), "odd-files")

    # The first unit of a file is its header.
    texts = stitching.joined_pieces(found.pieces.where(F.col("_unit") > 1), [], parsed).where(_is_text(F.col("text")))
    texts = materialize(texts.join(found.edges, ["file", "_unit"]).join(odd_files, "file", "left_anti"), "records")
    joined, sizes = stitching.local_places(texts, found)
    sizes = sizes.join(odd_files, "file", "left_anti")
    others = [unquote(r["file"]) for r in odd_files.collect()]
    if not others:
        return _documents(found, joined, sizes, _in_corpus_order(sizes)).select("doc_id", "text", "file")
    rest = _csv_values(_csv_reader(spark, others, True), text_column)
    of_rest = rest.groupBy("file", "_split").agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_rest = materialize(of_rest, "splits")
    starts = _in_corpus_order(sizes.select("file", "_split", "_n").unionByName(of_rest.drop("_first")))
    placed = rest.join(of_rest.drop("_n"), ["file", "_split"]).join(starts, ["file", "_split"])
    singles = placed.select((F.col("_start") + F.col("_seq") - F.col("_first")).alias("doc_id"), "text", "file")
    return _documents(found, joined, sizes, starts).select("doc_id", "text", "file").unionByName(singles)


def limit_docs(docs: DataFrame, max_docs: int | None, order: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """The first ``max_docs`` documents in corpus order."""
    if max_docs is None:
        return docs
    return take_first(docs, [F.col(c) if isinstance(c, str) else c for c in order], max_docs)


def read_corpus(
    spark: SparkSession,
    path: str,
    text_column: str | None = None,
    max_docs: int | None = None,
    is_csv: bool = False,
    min_doc_length: int = MIN_DOC_LENGTH,
) -> DataFrame:
    """Documents from a CSV or text file, at most ``max_docs``; an error when there is none."""
    if is_csv:
        docs = read_csv_texts(spark, path, text_column or TEXT_COLUMN)
    else:
        docs = read_paragraphs_or_lines(spark, path, min_doc_length)
    if docs.isEmpty():
        raise ValueError(f"no document is left of {path}")
    return limit_docs(docs, max_docs)


def corpus_profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents and mean (whole number), least and most characters."""
    n = F.length(text)
    return docs.agg(
        F.count(text).alias("n_docs"),
        F.bround(F.avg(n), 0).alias("avg_chars"),
        F.min(n).alias("min_chars"),
        F.max(n).alias("max_chars"),
    )


def chunk_docs(docs: DataFrame, chunk_size: int = 1000, overlap: int = 100, text: str = "text") -> DataFrame:
    """(doc_id, chunk, start, text): long texts cut into overlapping chunks."""
    starts = chunk_starts(F.length(text), chunk_size, overlap)
    rows = docs.select("doc_id", text, F.posexplode(starts).alias("chunk", "start"))
    return rows.select(
        "doc_id", "chunk", "start", F.substring(F.col(text), F.col("start") + 1, F.lit(chunk_size)).alias("text")
    )
