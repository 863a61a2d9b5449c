"""Word counts, vocabularies, coverage and out-of-vocabulary statistics.

The text is read once, by ``count_vocab``; everything else works on the table of
counts, which is as long as there are different words. No join here carries a
broadcast hint: a vocabulary is a stored table, whose size Catalyst knows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiframe.functions.hashing import hash_key
from lexiframe.functions.ids import SPECIAL_TOKENS
from lexiframe.functions.text import split_words
from lexiframe.operators.ranking import SMALL_LIMIT, number_in_order, take_by_key, take_first
from lexiframe.operators.summary import one_row
from lexiframe.session import materialize

# Defaults of the vocabulary step.
MIN_FREQ = 5
TOP_K = 5000
OOV_SAMPLE_WORDS = 20
OOV_CHECK_DOCS = 100
HISTOGRAM_ROWS = 20
# A task passes its counts on beyond so many different words.
COUNTED_WORDS = 1 << 17


def _frequency_order() -> list[Column]:
    return [F.desc("count"), F.asc("token")]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of the texts of a task; a word may come more than once."""
    counts: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        tokens = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([tokens, pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            counts.update(split_words(text.as_py() or b""))
            if len(counts) > COUNTED_WORDS:
                yield rows()
                counts.clear()
    yield rows()


def count_vocab(
    docs: DataFrame,
    text: str = "text",
    lowercase: bool = True,
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(token, count) over all documents.

    ``tokenizer`` replaces the word tokenizer: any function from a text column to
    an ``array<string>`` column, a pandas UDF included.
    """
    if tokenizer:
        return docs.select(F.explode(tokenizer(F.col(text))).alias("token")).groupBy("token").count()
    source = F.lower(text) if lowercase else F.col(text).cast("string")
    parts = docs.select(source.alias("text")).mapInArrow(_counted, "token string, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("count"))


def _threshold(frequent: DataFrame, top_k: int):
    """The frequency at which ``top_k`` words are reached, its number of words, and how many of them are due.

    None when there are no more words than that. Reads the counts of counts: one row per
    different frequency, see ``coverage_cutoff``.
    """
    hist = frequent.groupBy("count").agg(F.count(F.lit(1)).alias("types"))
    upto = W.orderBy(F.desc("count")).rowsBetween(W.unboundedPreceding, 0)
    cum = hist.select("count", "types", F.sum("types").over(upto).alias("cum"), F.sum("types").over(W.partitionBy()).alias("all"))
    hit = cum.where((F.col("cum") >= top_k) & (F.col("all") > top_k)).orderBy(F.desc("count")).first()
    return hit and (hit["count"], hit["types"], top_k - hit["cum"] + hit["types"])


def _most_frequent(counts: DataFrame, min_freq: int, top_k: int | None) -> DataFrame:
    """The words of a vocabulary, in no order: all above the threshold frequency, and the first of those at it."""
    frequent = counts.where(F.col("count") >= min_freq)
    if top_k is None:
        return frequent
    frequent = materialize(frequent, "frequent")
    found = _threshold(frequent, top_k)
    if found is None:
        return frequent
    cut, tied, due = found
    ties = frequent.where(F.col("count") == cut)
    if tied <= SMALL_LIMIT:
        ties = ties.orderBy("token").limit(due)
    else:
        ties = number_in_order(ties, ["token"], "_place").where(F.col("_place") <= due).drop("_place")
    return frequent.where(F.col("count") > cut).unionByName(ties)


def build_vocab(counts: DataFrame, min_freq: int = MIN_FREQ, top_k: int | None = TOP_K) -> DataFrame:
    """Words seen at least ``min_freq`` times, the ``top_k`` most frequent, ties by word.

    Only the words at the frequency where ``top_k`` is reached are put in order to cut them.
    """
    return _most_frequent(counts, min_freq, top_k).orderBy(*_frequency_order())


def special_rows(spark) -> DataFrame:
    """The four special tokens as vocabulary rows."""
    tokens = F.array(*[F.lit(t) for t in SPECIAL_TOKENS])
    return spark.range(1).select(F.posexplode(tokens).alias("id", "token")).select(
        "id", "token", F.lit(None).cast("long").alias("count")
    )


def assign_ids(counts: DataFrame, min_freq: int = MIN_FREQ, top_k: int | None = TOP_K) -> DataFrame:
    """The vocabulary (id, token, count): special tokens first, then words by frequency from 4 on."""
    first = len(SPECIAL_TOKENS)
    words = _most_frequent(counts, min_freq, top_k)
    if top_k is not None and top_k <= SMALL_LIMIT:
        words = words.withColumn("_rank", F.row_number().over(W.orderBy(*_frequency_order())))
    else:
        words = number_in_order(words, _frequency_order(), "_rank")
    words = words.select((F.col("_rank") + (first - 1)).cast("int").alias("id"), "token", "count")
    # Written, it has a known size and is not counted again by every reader.
    return materialize(special_rows(counts.sparkSession).unionByName(words), "vocabulary")


def _words(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.col("id") >= len(SPECIAL_TOKENS))


def in_vocab(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts of the words the vocabulary keeps."""
    return counts.join(_words(vocab).select("token"), "token", "left_semi")


def not_in_vocab(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Counts of the words the vocabulary lacks."""
    return counts.join(_words(vocab).select("token"), "token", "left_anti")


def oov_stats(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: tokens, out-of-vocabulary tokens, their percentage, their different words."""
    known = _words(vocab).select("token", F.lit(True).alias("_known"))
    unknown = F.col("_known").isNull()
    sums = counts.join(known, "token", "left").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.when(unknown, F.col("count"))), F.lit(0)).alias("oov_tokens"),
        F.count(F.when(unknown, F.lit(1))).alias("oov_types"),
    )
    rate = F.when(F.col("total_tokens") > 0, F.col("oov_tokens") / F.col("total_tokens") * 100).otherwise(F.lit(0.0))
    return sums.select("total_tokens", "oov_tokens", rate.alias("oov_rate"), "oov_types")


def sample_oov_words(counts: DataFrame, vocab: DataFrame, n: int = OOV_SAMPLE_WORDS) -> DataFrame:
    """The ``n`` most frequent words the vocabulary lacks."""
    return take_first(not_in_vocab(counts, vocab), _frequency_order(), n)


def oov_sample_docs(docs: DataFrame, sample_size: int | None = None, seed: int | None = None) -> DataFrame:
    """The documents an OOV check reads.

    With a ``seed``: a reproducible random sample of exactly ``sample_size``.
    Without: the first documents.
    """
    n = OOV_CHECK_DOCS if sample_size is None else sample_size
    if seed is None:
        return take_first(docs, [F.asc("doc_id")], n)
    return take_by_key(docs, hash_key(seed, "doc_id"), n)


def frequency_histogram(counts: DataFrame, n: int | None = HISTOGRAM_ROWS) -> DataFrame:
    """(frequency, n_types, coverage in percent), highest frequencies first."""
    hist = counts.groupBy(F.col("count").alias("frequency")).agg(F.count(F.lit(1)).alias("n_types"))
    tokens = F.col("frequency") * F.col("n_types")
    # One row per different frequency, see coverage_cutoff.
    hist = hist.withColumn("coverage", tokens / F.sum(tokens).over(W.partitionBy()) * 100)
    hist = hist.orderBy(F.desc("frequency"))
    return hist if n is None else hist.limit(n)


def _cutoff(counts: DataFrame, coverage_percent: float) -> DataFrame:
    """The frequency at which the target is reached, and how far it reaches."""
    hist = counts.groupBy(F.col("count").alias("f")).agg(F.count(F.lit(1)).alias("types"))
    upto = W.orderBy(F.desc("f")).rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy()
    cum = hist.select(
        "f",
        "types",
        F.sum(F.col("f") * F.col("types")).over(upto).alias("cum"),
        F.sum("types").over(upto).alias("cum_types"),
        F.sum(F.col("f") * F.col("types")).over(everything).alias("total_tokens"),
        F.sum("types").over(everything).alias("total_types"),
        F.min("f").over(everything).alias("lowest"),
    )
    target = F.col("total_tokens") * F.lit(coverage_percent / 100.0)
    # The first frequency that reaches the target, or the lowest one when none does.
    hit = cum.where((F.col("cum") >= target) | (F.col("f") == F.col("lowest"))).orderBy(F.desc("f")).limit(1)
    above = F.col("cum") - F.col("f") * F.col("types")
    guess = F.ceil((target - above) / F.col("f"))
    # Division may round over a whole number; test the neighbours.
    needed = (
        F.when(above + (guess - 1) * F.col("f") >= target, guess - 1)
        .when(above + guess * F.col("f") < target, guess + 1)
        .otherwise(guess)
    )
    needed = F.least(F.greatest(needed, F.lit(1)), F.col("types"))
    return hit.select(
        (F.col("cum_types") - F.col("types") + needed).alias("vocab_size"),
        F.col("f").alias("min_freq"),
        ((above + needed * F.col("f")) / F.col("total_tokens") * 100).alias("coverage"),
        "total_types",
        "total_tokens",
        F.col("cum_types").alias("final_size"),
        (F.col("cum") / F.col("total_tokens") * 100).alias("final_coverage"),
    )


def coverage_cutoff(counts: DataFrame, coverage_percent: float = 95.0) -> DataFrame:
    """How many words, most frequent first, it takes to cover a share of all tokens.

    Works on the number of words per frequency. A corpus of N tokens has at most
    sqrt(2 N) different frequencies, so the window over them stays small.
    """
    return _cutoff(counts, coverage_percent).drop("final_size", "final_coverage")


def coverage_vocab(counts: DataFrame, coverage_percent: float = 95.0) -> DataFrame:
    """The vocabulary of all words at or above the cut-off frequency, ties included."""
    min_freq = coverage_cutoff(counts, coverage_percent).first()["min_freq"]
    return assign_ids(counts, min_freq, None)


def coverage_stats(counts: DataFrame, coverage_percent: float = 95.0) -> DataFrame:
    """One row: the cut-off and what the vocabulary rebuilt from it really covers."""
    return _cutoff(counts, coverage_percent)


def build_stats(
    docs: DataFrame,
    min_freq: int = MIN_FREQ,
    top_k: int | None = TOP_K,
    check_docs: int = OOV_CHECK_DOCS,
    counts: DataFrame | None = None,
    lowercase: bool = True,
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row on a vocabulary build: sizes, settings and OOV on the first documents.

    With ``counts``, the stored word counts of the build, the text is read only for the
    number of documents and the check on the first ones; these are cut into words as ``counts`` was.
    """
    if counts is None:
        counts = count_vocab(docs, "text", lowercase, tokenizer)
    vocab = assign_ids(counts, min_freq, top_k)
    checked = materialize(count_vocab(oov_sample_docs(docs, check_docs), "text", lowercase, tokenizer), "checked")
    oov = oov_stats(checked, vocab)
    # At most OOV_SAMPLE_WORDS rows.
    unknown = F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "token")))
    samples = sample_oov_words(checked, vocab).agg(unknown.alias("_w")).select(F.col("_w.token").alias("sample_oov_words"))
    return one_row(
        docs.agg(F.count(F.lit(1)).alias("n_documents")),
        _words(vocab).agg(F.count(F.lit(1)).alias("vocab_size")),
        counts.agg(F.sum("count").alias("total_tokens"), F.count(F.lit(1)).alias("unique_tokens")),
        oov.select(
            F.col("total_tokens").alias("oov_check_tokens"), "oov_tokens", "oov_rate", "oov_types"
        ),
        samples,
    ).select(
        "*", F.array(*map(F.lit, SPECIAL_TOKENS)).alias("special_tokens"), F.lit(min_freq).alias("min_freq"), F.lit(top_k).cast("int").alias("top_k")
    )
