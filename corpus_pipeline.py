"""The corpus pipeline: five stages over ``documents``, each one of the operators in ``lexiframe.llm``.

Every stage is a function (spark, docs, sf_dir) -> DataFrame that works on all rows its
predecessor kept; its result is written as Parquet and read again as the next one's docs.
So when a stage begins, the copies its predecessor worked with are read no more and go.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.llm import decontaminate, jaccard, langid, packing, repeats
from lexiframe.llm.keys import original, present
from lexiframe.session import delete_copies, discard, let_workers_import, materialize, recorded_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Texts are long: an Arrow batch of Spark's 10,000 of them takes too much of a Python worker's memory.
BATCH_ROWS = 1000
# A text whose main language has a smaller share of its distinct words' letters is rejected.
MIN_LANGUAGE_SHARE = 0.35
# Near copies share so much of their shingles of so many words; 4 words and 85 % hold for op6_ngram_jaccard only.
NEAR_WORDS, NEAR_PERCENT = 5, 80


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# The copies of the stage that ran last.
_left: list[str] = []


def _stage(work: Stage) -> Stage:
    """Delete what the stage before has left, and remember what this one leaves."""

    @wraps(work)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_copies(spark, _left)
        _left.clear()
        with recorded_copies() as made:
            try:
                return work(spark, docs, sf_dir)
            finally:
                _left.extend(made)

    return call


def _by_row(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("doc_id", present("doc_id"))


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows for the jobs of this session; a smaller setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no known language or without a main one; the rest stays as it is."""
    _small_batches(spark)
    found = langid.identify_languages(docs.select(*COLUMNS), langid.learn_languages(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE)).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (5-word shingles, Jaccard >= 0.8) the document with the smallest id stays."""
    _small_batches(spark)
    found = jaccard.similar_components(docs, NEAR_WORDS, NEAR_PERCENT)
    copies = found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
    copies = copies.select(present("doc_id")).distinct()
    kept = _by_row(docs).join(copies, "doc_id", "left_anti")
    return kept.withColumn("doc_id", original("doc_id")).select(*COLUMNS)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document go; documents left without a word go with them."""
    _small_batches(spark)
    cut = repeats.remove_repeats(docs.select(*COLUMNS))
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.col("n_removed") > 0
    return left.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))).withColumn(
        "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    _small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), items).select(*COLUMNS)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bucket, batch and slot."""
    _small_batches(spark)
    return packing.pack(packing.token_lengths(docs))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packed),
]

# No SQL for trained language models, components and dynamic programming; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = kept
    delete_copies(spark, _left)
    _left.clear()
    return docs
