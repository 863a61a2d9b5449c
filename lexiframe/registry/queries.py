"""Every operator as a query over the given tables.

Large results are reported per document or class, with a checksum over all rows, so
that comparing them stays cheap while every row counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexiframe.functions.ids import context_length, left_pad_context, pad_ids, truncate_ids, type_token_ratio, unk_count
from lexiframe.functions.sequences import weighted_sums
from lexiframe.functions.text import tokenize
from lexiframe.operators import conversations, dataset, embeddings, encoding, features, generation, metrics
from lexiframe.operators import next_token, sampling, splitting, vocabulary
from lexiframe.operators.feature_model import ContextFeatures, ContextFeaturesModel
from lexiframe.operators.running import BLOCK
from lexiframe.session import materialize, new_path
from lexiframe.sources import artifacts, corpus, word_vectors
from lexiframe.streaming.conversations import keep_rolling_context, stream_rolling_context

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Settings of the queries; the SQL in ``oracles`` uses the same.
L = 16
SEED = 42
MAX_SAMPLES = 100_000
SCORED_TOP_K = 5000
MODEL_TOP_K = 5000
CHAT_WINDOW = 32


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def vocab_of(spark: SparkSession, sf: str, top_k: int | None = 5000) -> DataFrame:
    return vocabulary.assign_ids(vocabulary.count_vocab(documents(spark, sf)), 5, top_k)


def encoded(spark: SparkSession, sf: str, top_k: int | None = 5000) -> DataFrame:
    return encoding.encode(documents(spark, sf), vocab_of(spark, sf, top_k), add_bos_eos=True, in_tasks=True)


def windows(spark: SparkSession, sf: str, top_k: int | None = 5000, length: int = L, stored: bool = False) -> DataFrame:
    """Context rows; ``stored`` keeps the encoded documents for steps that read them more than once."""
    rows = encoded(spark, sf, top_k)
    return dataset.context_windows(materialize(rows, "encoded") if stored else rows, length)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("vec"))


def embedded_windows(spark: SparkSession, sf: str, stored: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Context rows over a vocabulary as large as the embedding table, and that table.

    By default encoded documents are kept where pools and lookups read the contexts twice, that is over a large table.
    """
    vecs = vectors(spark, sf)
    n, dim = vecs.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if stored is None:
        stored = n * max(dim or 0, 0) * 4 > features.MATRIX_BYTES
    return windows(spark, sf, n - 4, stored=stored), vecs


def joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


def checksum(*parts: Column) -> Column:
    """Sum over all rows of the first 32 bits of an md5; the order of rows does not matter."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).alias("checksum")


def row_checksum() -> Column:
    return checksum(F.col("doc_id"), F.col("pos"), F.col("y"), joined(F.col("ctx")))


def rounded(column: Column, name: str, digits: int = 6) -> Column:
    return F.round(column, digits).alias(name)


def weighted(vec: Column) -> Column:
    """sum of i * v_i: one number that depends on every element."""
    return F.aggregate(
        F.transform(vec, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda total, x: total + x
    )


def weighted_in_batches(column: Column) -> Column:
    """``weighted`` for columns with a vector per context; vectors without null elements."""

    @F.arrow_udf(DoubleType())
    def weighted_sum(vecs: pa.Array) -> pa.Array:
        return weighted_sums(vecs)

    return weighted_sum(column)


def square_in_batches(column: Column) -> Column:
    """The squared length of a vector, for vectors of one width."""

    @F.arrow_udf(DoubleType())
    def square(vecs: pa.Array) -> pa.Array:
        m = vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1) if len(vecs) else np.zeros((0, 1))
        return pa.array(np.einsum("ij,ij->i", m, m))

    return square(column)


def extremes_in_batches(column: Column) -> Column:
    """(least, most, n) of the elements of a vector, as Spark's array functions find them; vectors of one width."""

    @F.arrow_udf("struct<least: double, most: double, n: int>")
    def extremes(vecs: pa.Array) -> pa.Array:
        n = len(vecs)
        m = vecs.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
        # NaN is greater than any number.
        found = [pa.array(np.fmin.reduce(m, axis=1)), pa.array(m.max(axis=1)), pa.array(np.full(n, m.shape[1], np.int32))]
        return pa.StructArray.from_arrays(found, ["least", "most", "n"])

    return extremes(column)


def size_and_weighted_in_batches(column: Column) -> Column:
    """(n, v): the size of an ML vector and its ``weighted`` sum; dense vectors."""

    @F.arrow_udf("struct<n: int, v: double>")
    def sums(vecs: pa.Array) -> pa.Array:
        if (vecs.field("type").to_numpy(zero_copy_only=False) != 1).any():
            raise ValueError("a vector is not dense")
        values = vecs.field("values")
        return pa.StructArray.from_arrays([values.value_lengths(), weighted_sums(values)], ["n", "v"])

    return sums(column)


def per_doc(rows: DataFrame, value: Column) -> DataFrame:
    return rows.select("doc_id", value.alias("v")).groupBy("doc_id").agg(
        rounded(F.avg("v"), "avg_value", 5), rounded(F.min("v"), "min_value", 5), rounded(F.max("v"), "max_value", 5)
    )


# --- sources and sinks -------------------------------------------------------------


@query
def read_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "text")
    documents(spark, sf).select("text").write.text(path, lineSep="\n\n")
    docs = corpus.read_paragraphs(spark, path)
    return docs.groupBy(F.md5("text").alias("text_md5"), F.length("text").alias("n_chars")).agg(
        F.count(F.lit(1)).alias("n_copies")
    )


@query
def paragraphs_or_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One directory per language and source; those with fewer than 10 paragraphs are read by lines."""
    path = new_path(spark, "text")
    docs = corpus.spread(table(spark, sf, "documents").select("lang", "source", "text"), "lang", "source")
    docs.write.partitionBy("lang", "source").text(path, lineSep="\n\n")
    read = corpus.read_paragraphs_or_lines(spark, path, unit="directory")
    return read.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), checksum(F.col("text"))
    )


@query
def read_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "text")
    documents(spark, sf).select("text").write.text(path)
    lines = corpus.read_lines(spark, path)
    return lines.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n_copies"))


@query
def read_csv_texts(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "csv")
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    documents(spark, sf).write.options(**options).csv(path)
    docs = corpus.read_csv_texts(spark, path)
    return docs.groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n_copies"))


@query
def limit_docs(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.limit_docs(documents(spark, sf), 100).select("doc_id", F.md5("text").alias("text_md5"))


@query
def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_profile(documents(spark, sf))


@query
def write_read_vocab(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "vocab")
    artifacts.write_vocab(vocab_of(spark, sf), path)
    return artifacts.read_vocab(spark, path)


@query
def write_read_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "tokenizer")
    artifacts.write_tokenizer(vocab_of(spark, sf), path)
    vocab, options = artifacts.read_tokenizer(spark, path)
    settings = [F.lit(getattr(options, n)).alias(n) for n in ("pad_id", "unk_id", "bos_id", "eos_id", "lowercase")]
    return vocab.select("id", "token", *settings)


@query
def dataset_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Written, read back, and described per split."""
    path = new_path(spark, "dataset")
    artifacts.write_dataset(splitting.train_val_split(windows(spark, sf, stored=True)), path)
    rows = artifacts.read_dataset(spark, path)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max(F.size("ctx")).alias("context_length"),
        F.countDistinct("y").alias("n_unique_targets"),
        row_checksum(),
    )


@query
def stored_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """What ``write_dataset`` says about the rows it has written."""
    path = new_path(spark, "dataset")
    artifacts.write_dataset(windows(spark, sf, stored=True), path)
    return spark.read.json(f"{path}/metadata").select("n_samples", "context_length", "n_unique_targets")


@query
def import_vocab_json(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary by way of one JSON object of tokens and frequencies."""
    path = new_path(spark, "vocab-json")
    words = F.sort_array(F.collect_list(F.struct("id", "token", "count")))
    record = vocab_of(spark, sf).where("id >= 4").agg(words.alias("w")).select(
        F.to_json(
            F.struct(
                F.col("w.token").alias("tokens"),
                F.map_from_arrays(F.col("w.token"), F.col("w.count")).alias("frequencies"),
            )
        ).alias("value")
    )
    record.write.text(path)
    return artifacts.import_vocab_json(spark, path)


@query
def write_read_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of prompts as written with the settings, and as plain text."""
    path = new_path(spark, "generations")
    texts = table(spark, sf, "benchmark").select(F.col("text").alias("prompt"), F.lower("text").alias("generated"))
    rows = sampling.samples_per_prompt(texts, 2).select("prompt", "sample_idx", "generated")
    artifacts.write_generations(rows, f"{path}/json", sampling="top_k", top_k=10)
    artifacts.write_generations(rows, f"{path}/text", as_text=True)
    stored = spark.read.json(f"{path}/json").groupBy(F.md5("prompt").alias("prompt_md5"), "sampling", "top_k").agg(
        F.count(F.lit(1)).alias("n_samples"), checksum(F.col("sample_idx"), F.col("generated"))
    )
    lines = spark.read.text(f"{path}/text").where(F.col("value").startswith("Generated: "))
    return stored.crossJoin(lines.agg(F.count(F.lit(1)).alias("n_texts")))


@query
def read_text_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "vectors")
    line = F.concat_ws(" ", F.concat(F.lit("w"), F.col("id").cast("string")), joined(F.col("vec")))
    vectors(spark, sf).select(line.alias("value")).write.text(path)
    read = word_vectors.read_text_embeddings(spark, path)
    return read.select("token", F.size("vec").alias("dim"), rounded(weighted(F.col("vec")), "weighted", 4))


@query
def read_prompts(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "prompts")
    table(spark, sf, "benchmark").select("text").write.text(path)
    return artifacts.read_prompts(spark, path).groupBy("prompt").agg(F.count(F.lit(1)).alias("n_copies"))


@query
def build_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = vocabulary.build_stats(documents(spark, sf))
    lists = [F.array_join(c, " ").alias(c) for c in ("special_tokens", "sample_oov_words")]
    return stats.withColumn("oov_rate", F.round("oov_rate", 6)).select(
        *[c for c in stats.columns if c not in ("special_tokens", "sample_oov_words")], *lists
    )


def _profile_rounded(profile: DataFrame) -> DataFrame:
    """Ratios rounded, the most frequent targets as y:token:count."""
    ratios = ("padding_ratio", "unk_ratio_x", "unk_ratio_y")
    targets = F.transform("top_targets", lambda t: F.concat_ws(":", t["y"].cast("string"), t["token"], t["count"].cast("string")))
    return profile.withColumn("top_targets", F.array_join(targets, " ")).select(
        *[F.round(c, 8).alias(c) if c in ratios else F.col(c) for c in profile.columns]
    )


@query
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    vocab = materialize(vocab_of(spark, sf), "vocab")
    rows = windows(spark, sf, stored=True)
    stats = dataset.dataset_stats(rows, vocab, documents(spark, sf), min_freq=5, top_k=5000, seed=SEED)
    return _profile_rounded(stats)


# --- text and token IDs ------------------------------------------------------------


@query
def tokenize_text(spark: SparkSession, sf: str) -> DataFrame:
    words = documents(spark, sf).select("doc_id", tokenize(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query
def tokenize_cased(spark: SparkSession, sf: str) -> DataFrame:
    words = documents(spark, sf).select("doc_id", tokenize(F.col("text"), lowercase=False).alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    chunks = corpus.chunk_docs(documents(spark, sf))
    return chunks.select("doc_id", "chunk", "start", F.md5("text").alias("text_md5"))


def _ids_summary(rows: DataFrame, ids: Column) -> DataFrame:
    named = rows.select("doc_id", ids.alias("ids"))
    return named.select("doc_id", F.size("ids").alias("n_ids"), F.md5(joined(F.col("ids"))).alias("ids_md5"))


@query
def encode(spark: SparkSession, sf: str) -> DataFrame:
    return _ids_summary(encoded(spark, sf), F.col("ids"))


@query
def truncate(spark: SparkSession, sf: str) -> DataFrame:
    return _ids_summary(encoded(spark, sf), truncate_ids(F.col("ids"), 64, keep_eos=True))


@query
def pad(spark: SparkSession, sf: str) -> DataFrame:
    return _ids_summary(encoded(spark, sf), pad_ids(F.col("ids"), 256))


@query
def left_pad(spark: SparkSession, sf: str) -> DataFrame:
    return _ids_summary(encoded(spark, sf), left_pad_context(F.col("ids"), 256))


@query
def decode(spark: SparkSession, sf: str) -> DataFrame:
    texts = encoding.decode(encoded(spark, sf), vocab_of(spark, sf))
    return texts.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# --- vocabulary --------------------------------------------------------------------


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.count_vocab(documents(spark, sf))


@query
def count_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


@query
def count_vocab_custom(spark: SparkSession, sf: str) -> DataFrame:
    """A tokenizer passed in by the caller: split on blanks only."""
    return vocabulary.count_vocab(
        documents(spark, sf), tokenizer=lambda text: F.array_remove(F.split(text, " "), "")
    )


@query
def build_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.build_vocab(_counts(spark, sf))


@query
def assign_ids(spark: SparkSession, sf: str) -> DataFrame:
    return vocab_of(spark, sf)


@query
def assign_ids_unlimited(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.assign_ids(_counts(spark, sf), 1, None)


@query
def in_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.in_vocab(_counts(spark, sf), vocab_of(spark, sf))


@query
def not_in_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.not_in_vocab(_counts(spark, sf), vocab_of(spark, sf))


@query
def oov_stats(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.oov_stats(_counts(spark, sf), vocab_of(spark, sf)).withColumn("oov_rate", F.round("oov_rate", 6))


@query
def sample_oov_words(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.sample_oov_words(_counts(spark, sf), vocab_of(spark, sf))


@query
def oov_sample_docs(spark: SparkSession, sf: str) -> DataFrame:
    """OOV over a random sample of 200 documents and over the first 100."""
    docs, vocab = documents(spark, sf), vocab_of(spark, sf)
    picked = {
        "random": vocabulary.oov_sample_docs(docs, 200, seed=SEED),
        "first": vocabulary.oov_sample_docs(docs),
    }
    parts = [
        vocabulary.oov_stats(vocabulary.count_vocab(d), vocab).select(
            F.lit(name).alias("sample"), "total_tokens", "oov_tokens", F.round("oov_rate", 6).alias("oov_rate"), "oov_types"
        )
        for name, d in picked.items()
    ]
    return parts[0].unionByName(parts[1])


@query
def coverage_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    counts = _counts(spark, sf)
    parts = [
        vocabulary.coverage_cutoff(counts, p).select(F.lit(p).alias("target"), "*") for p in (50.0, 80.0, 95.0, 100.0)
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return both.withColumn("coverage", F.round("coverage", 6))


@query
def coverage_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.coverage_vocab(materialize(_counts(spark, sf), "counts"), 80.0)


@query
def coverage_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = vocabulary.coverage_stats(_counts(spark, sf), 80.0)
    return stats.withColumn("coverage", F.round("coverage", 6)).withColumn(
        "final_coverage", F.round("final_coverage", 6)
    )


@query
def frequency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.frequency_histogram(_counts(spark, sf)).withColumn("coverage", F.round("coverage", 6))


# --- training rows -----------------------------------------------------------------


@query
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows(spark, sf)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("y_sum"), row_checksum())


@query
def shuffle_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = dataset.shuffle_rows(windows(spark, sf, stored=True).select("doc_id", "pos", "y"), SEED, place="place")
    return rows.groupBy("doc_id").agg(
        F.sum("place").alias("place_sum"),
        F.min("place").alias("place_min"),
        F.max("place").alias("place_max"),
        checksum(F.col("pos"), F.col("place"), F.col("y")),
    )


@query
def limit_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = dataset.limit_samples(windows(spark, sf, stored=True), MAX_SAMPLES, seed=SEED)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), row_checksum())


@query
def limit_samples_in_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = dataset.limit_samples(windows(spark, sf, stored=True), MAX_SAMPLES, shuffle=False)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), row_checksum())


@query
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = splitting.train_val_split(windows(spark, sf, stored=True), 0.1, SEED)
    return rows.groupBy("doc_id", "split").agg(F.count(F.lit(1)).alias("n_rows"), row_checksum())


@query
def ordered_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = splitting.ordered_split(windows(spark, sf, stored=True).select("doc_id", "pos", "y"), 0.1)
    return rows.groupBy("doc_id", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("y_sum"))


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = splitting.stratified_split(windows(spark, sf, stored=True).select("doc_id", "pos", "y"), 0.1, SEED)
    return rows.groupBy("y", "split").agg(F.count(F.lit(1)).alias("n_rows"), checksum(F.col("doc_id"), F.col("pos")))


@query
def n_unique(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.n_unique(windows(spark, sf, stored=True))


@query
def merged_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches per part of the rows, merged: the same estimate as one sketch of all, near the exact count."""
    rows = windows(spark, sf, stored=True)
    parts = dataset.unique_sketches(rows, F.pmod("doc_id", F.lit(7)).alias("part"))
    merged = dataset.merge_unique(materialize(parts, "sketches"))
    single = dataset.merge_unique(dataset.unique_sketches(rows, F.lit(0).alias("part")))
    names = ("n_unique_contexts", "n_unique_targets")
    exact = dataset.n_unique(rows)
    pairs = merged.select(*[F.col(n).alias(f"_{n}") for n in names]).crossJoin(single.select(*[F.col(n).alias(f"_1{n}") for n in names]))
    return exact.crossJoin(pairs).select(
        *names,
        *[(F.col(f"_{n}") == F.col(f"_1{n}")).alias(f"{n}_merge") for n in names],
        *[(F.abs(F.col(f"_{n}") / F.col(n) - 1) < dataset.SKETCH_ERROR).alias(f"{n}_near") for n in names],
    )


@query
def dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    vocab = materialize(vocab_of(spark, sf), "vocab")
    return _profile_rounded(dataset.dataset_profile(windows(spark, sf, stored=True), vocab))


@query
def top_targets(spark: SparkSession, sf: str) -> DataFrame:
    vocab = materialize(vocab_of(spark, sf), "vocab")
    rows = dataset.context_windows(encoding.encode(documents(spark, sf), vocab, add_bos_eos=True), L)
    return dataset.top_targets(rows, vocab).withColumn("frequency", F.round("frequency", 8))


@query
def padding_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.padding_ratio(windows(spark, sf)).select(F.round("padding_ratio", 8).alias("padding_ratio"))


@query
def unk_ratios(spark: SparkSession, sf: str) -> DataFrame:
    ratios = dataset.unk_ratios(windows(spark, sf))
    return ratios.select(*[F.round(c, 8).alias(c) for c in ratios.columns])


@query
def feature_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = dataset.feature_columns(windows(spark, sf), L)
    names = dataset.feature_names(L)
    return rows.groupBy("doc_id").agg(*[F.sum(F.col(f"`{n}`")).alias(n.replace("-", "_")) for n in names])


# --- features ----------------------------------------------------------------------


@query
def context_length_feature(spark: SparkSession, sf: str) -> DataFrame:
    return per_doc(windows(spark, sf), context_length(F.col("ctx")))


@query
def unk_count_feature(spark: SparkSession, sf: str) -> DataFrame:
    return per_doc(windows(spark, sf), unk_count(F.col("ctx")))


@query
def type_token_ratio_feature(spark: SparkSession, sf: str) -> DataFrame:
    return per_doc(windows(spark, sf), type_token_ratio(F.col("ctx")))


def _word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors for the words of all documents: vector i for the word with ID i; IDs without a vector stay without."""
    return vocab_of(spark, sf).join(vectors(spark, sf), "id").select("token", "vec")


@query
def align_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    vecs = materialize(_word_vectors(spark, sf), "vectors")
    aligned = embeddings.align_embeddings(vocab_of(spark, sf), vecs, "mean", special_rules=True)
    return aligned.select("id", "token", "found", rounded(weighted(F.col("vec")), "weighted", 3))


@query
def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    vecs = materialize(_word_vectors(spark, sf), "vectors")
    aligned = embeddings.align_embeddings(vocab_of(spark, sf), vecs, "zero", special_rules=False)
    return embeddings.embedding_coverage(aligned).withColumn("coverage", F.round("coverage", 6))


@query
def embedding_size_check(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned vectors fit their vocabulary; the check raises an error where they do not."""
    vocab = vocab_of(spark, sf)
    aligned = materialize(embeddings.align_embeddings(vocab, _word_vectors(spark, sf), "zero"), "aligned")
    embeddings.embedding_size_check(aligned, vocab)
    return aligned.agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size("vec")).alias("dim"))


def _pooled(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    rows, vecs = embedded_windows(spark, sf)
    return per_doc(features.pool_embeddings(rows, vecs, (kind,)), weighted_in_batches(F.col(f"{kind}_pooled")))


@query
def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _pooled(spark, sf, "mean")


@query
def max_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _pooled(spark, sf, "max")


@query
def position_weighted_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _pooled(spark, sf, "position")


@query
def nearest_tokens(spark: SparkSession, sf: str) -> DataFrame:
    sims = embeddings.nearest_similarities(vectors(spark, sf))
    return sims.select("id", F.posexplode("sims").alias("place", "sim")).select("id", "place", rounded(F.col("sim"), "sim"))


@query
def last_token_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows, vecs = embedded_windows(spark, sf)
    return per_doc(embeddings.last_token_similarity(rows, vecs), weighted_in_batches(F.col("last_token_sims")))


@query
def prototype_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows, vecs = embedded_windows(spark, sf)
    centres = features.fit_prototypes(vecs, 50)
    pooled = features.prototype_similarity(features.pool_embeddings(rows, vecs, ("mean",)), centres)
    sims = pooled.select("doc_id", extremes_in_batches(F.col("prototype_sims")).alias("s")).select("doc_id", "s.*")
    return sims.groupBy("doc_id").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("n").alias("n"))


@query
def pca_reduce(spark: SparkSession, sf: str) -> DataFrame:
    rows, vecs = embedded_windows(spark, sf, stored=True)
    pooled = features.pool_embeddings(rows, vecs, ("mean",)).select("doc_id", "mean_pooled")
    reduced = features.pca_reduce(pooled, "mean_pooled", 8)
    return reduced.groupBy("doc_id").agg(
        F.max(F.size("mean_pooled")).alias("dim"), F.avg(F.abs(F.col("mean_pooled")[0])).alias("first_component")
    )


N_GIVEN = 4


@query
def given_prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """Cosines of the pooled contexts to the first vectors of the table as prototypes."""
    rows, vecs = embedded_windows(spark, sf)
    centres = vecs.where(F.col("id") < N_GIVEN).orderBy("id").collect()
    pooled = features.pool_embeddings(rows, vecs, ("mean",))
    sims = features.prototype_similarity(pooled, np.array([r["vec"] for r in centres], dtype=np.float64))
    return per_doc(sims, weighted_in_batches(F.col("prototype_sims")))


@query
def pca_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """With all components a reduced row is as long as the centred one."""
    rows, vecs = embedded_windows(spark, sf, stored=True)
    pooled = features.pool_embeddings(rows, vecs, ("mean",)).select("doc_id", "mean_pooled")
    dim = embeddings.dimension(vecs)
    model = features.fit_pca(pooled, "mean_pooled", dim)
    reduced = features.project(pooled, "mean_pooled", model)
    return per_doc(reduced, square_in_batches(F.col("mean_pooled")))


@query
def feature_model(spark: SparkSession, sf: str) -> DataFrame:
    """Prototypes and PCA fit on the training rows, saved, loaded and applied to the validation rows."""
    rows, vecs = embedded_windows(spark, sf, stored=True)
    split = splitting.train_val_split(rows, 0.1, SEED)
    options = features.FeatureOptions(mean_pooled=True, prototypes=True, max_pooled=True, reduce_to=8)
    path = new_path(spark, "feature-model")
    ContextFeatures(options, vecs).fit(split.where(F.col("split") == "train")).save(path)
    scored = ContextFeaturesModel.load(path).transform(split.where(F.col("split") == "val"))
    values = scored.select("doc_id", vector_to_array("features").alias("f"))
    return values.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("f")).alias("n_features"))


@query
def assemble_features(spark: SparkSession, sf: str) -> DataFrame:
    rows, vecs = embedded_windows(spark, sf, stored=True)
    options = features.FeatureOptions(mean_pooled=True, last_token=True, position_pooled=True, max_pooled=True)
    built, names, categorical = features.assemble_features(rows, options, vecs)
    values = built.select("doc_id", size_and_weighted_in_batches(F.col("features")).alias("f")).select("doc_id", "f.*")
    return values.groupBy("doc_id").agg(
        F.max("n").alias("n_features"),
        F.lit(len(categorical)).alias("n_categorical"),
        rounded(F.avg("v"), "avg_weighted", 3),
    )


# --- scored tables and metrics -----------------------------------------------------


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """p(next token | last token), from the counts of neighbouring tokens."""
    rows = windows(spark, sf, SCORED_TOP_K, 1)
    pairs = rows.groupBy(F.col("ctx")[0].alias("ctx_id"), F.col("y").alias("token_id")).count()
    pairs = materialize(pairs, "pairs")
    totals = pairs.groupBy("ctx_id").agg(F.sum("count").alias("total"))
    return pairs.join(totals, "ctx_id").select("ctx_id", "token_id", (F.col("count") / F.col("total")).alias("p"))


def _p_rounded(rows: DataFrame) -> DataFrame:
    return rows.select("ctx_id", "token_id", F.round("p", 8).alias("p"))


@query
def apply_temperature(spark: SparkSession, sf: str) -> DataFrame:
    return _p_rounded(sampling.apply_temperature(scored(spark, sf), 0.7))


@query
def pick_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return _p_rounded(sampling.pick_greedy(scored(spark, sf)))


@query
def filter_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return _p_rounded(sampling.filter_top_k(scored(spark, sf), 10))


@query
def filter_top_p(spark: SparkSession, sf: str) -> DataFrame:
    return _p_rounded(sampling.filter_top_p(scored(spark, sf), 0.9))


@query
def draw(spark: SparkSession, sf: str) -> DataFrame:
    kept = sampling.filter_top_k(scored(spark, sf), 10)
    return sampling.draw(kept, SEED, step=0, n_samples=3)


@query
def sample_temperature(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_tokens(scored(spark, sf), "temperature", temperature=0.7, seed=SEED)


@query
def samples_per_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompts = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), F.md5("text").alias("prompt_md5"))
    return sampling.samples_per_prompt(prompts, 3)


def _model_rows(spark: SparkSession, sf: str, top_k: int = MODEL_TOP_K) -> tuple[DataFrame, DataFrame]:
    """Rows with as many tokens of context as the model looks at, and the vocabulary."""
    vocab = materialize(vocab_of(spark, sf, top_k), "vocab")
    ids = materialize(encoding.encode(documents(spark, sf), vocab, add_bos_eos=True, in_tasks=True), "encoded")
    return dataset.context_windows(ids, next_token.ORDER), vocab


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with the most likely next token after the last two, or fewer where these are unknown, and the loss."""
    rows, vocab = _model_rows(spark, sf)
    return next_token.score_targets(rows, next_token.fit_next_token_model(rows), vocab.count())


def _whole_report(spark: SparkSession, sf: str) -> DataFrame:
    rows, vocab = _model_rows(spark, sf)
    pairs = materialize(next_token.count_targets(rows), "pairs")
    return next_token.model_report(pairs, next_token.fit_next_token_model(pairs, counted=True), vocab.count(), (), counted=True)


@query
def argmax_class(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).groupBy("doc_id", "y_pred").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.accuracy(predictions(spark, sf)).withColumn("accuracy", F.round("accuracy", 8))


@query
def label_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """The two label columns as truth and guess."""
    return metrics.accuracy(table(spark, sf, "labels"), "quality", "toxic").withColumn("accuracy", F.round("accuracy", 8))


@query
def multi_logloss(spark: SparkSession, sf: str) -> DataFrame:
    return _whole_report(spark, sf).select(rounded(F.col("logloss"), "logloss", 8))


@query
def perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return _whole_report(spark, sf).select(rounded(F.col("perplexity"), "perplexity", 7))


@query
def metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    """The model knows the training rows only; unseen contexts back off to shorter ones."""
    rows, vocab = _model_rows(spark, sf)
    split = splitting.train_val_split(rows, 0.1, SEED)
    pairs = materialize(next_token.count_targets(split, by=("split",)), "pairs")
    model = next_token.fit_next_token_model(pairs.where(F.col("split") == "train"), counted=True)
    report = next_token.model_report(pairs, model, vocab.count(), counted=True)
    return report.select(
        "split", "n_rows", *[F.round(c, 7).alias(c) for c in ("accuracy", "logloss", "perplexity")]
    )


def source_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the number of their language as ``y`` and the shares of all languages in their source as ``p``."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source").where("lang IS NOT NULL AND source IS NOT NULL")
    langs = docs.select("lang").distinct().agg(F.sort_array(F.collect_list("lang")).alias("langs"))
    counts = docs.groupBy("source", "lang").count().groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("n"))
    counted = F.transform("langs", lambda x: F.coalesce(F.element_at("n", x), F.lit(0)).cast("double"))
    shares = counts.join(F.broadcast(langs)).select("source", "langs", metrics.normalise(counted).alias("p"))
    return docs.join(shares, "source").select("doc_id", "source", (F.array_position("langs", F.col("lang")) - 1).cast("int").alias("y"), "p")


@query
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of arrays of probabilities, each by its own function, per source."""
    rows = source_shares(spark, sf)
    guessed = rows.withColumn("y_pred", metrics.argmax_class(F.col("p")))
    report = metrics.metrics_report(rows, "source").select("source", "n_rows", F.col("logloss").alias("report_logloss"))
    parts = [
        guessed.groupBy("source").agg(F.max("y_pred").alias("y_pred")),
        metrics.accuracy(guessed, by=["source"]),
        metrics.multi_logloss(rows, by=["source"]),
        metrics.perplexity(rows, by=["source"]),
    ]
    for part in parts:
        report = report.join(part, "source")
    measures = ("accuracy", "report_logloss", "logloss", "perplexity")
    return report.select("source", "n_rows", "y_pred", *[F.round(c, 8).alias(c) for c in measures])


# --- conversations -----------------------------------------------------------------


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.spread(table(spark, sf, "conversations"), "conv_id", "turn")


def _system() -> Column:
    """The tables hold no typed reset; a system turn opens a new session instead."""
    return F.col("role") == "system"


@query
def conversation_sessions(spark: SparkSession, sf: str) -> DataFrame:
    turns = conversations.conversation_sessions(_turns(spark, sf), is_reset=_system())
    return turns.select("conv_id", "turn", "role", "session_id", F.md5("text").alias("text_md5"))


@query
def conversation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.conversation_stats(
        _turns(spark, sf), vocab_of(spark, sf), CHAT_WINDOW, is_reset=_system(), eos_roles=("assistant",)
    )


def _contexts_as_text(contexts: DataFrame) -> DataFrame:
    return contexts.withColumn("ctx", joined(F.col("ctx"))).drop("batch")


@query
def rolling_context(spark: SparkSession, sf: str) -> DataFrame:
    return _contexts_as_text(
        conversations.rolling_context(
            _turns(spark, sf), vocab_of(spark, sf), CHAT_WINDOW, is_reset=_system(), eos_roles=("assistant",)
        )
    )


@query
def streaming_rolling_context(spark: SparkSession, sf: str) -> DataFrame:
    """The turns as a stream of files, the later half after a restart; must equal ``rolling_context``."""
    turns = table(spark, sf, "conversations")
    source, out = new_path(spark, "turns"), new_path(spark, "stream")
    vocab = materialize(vocab_of(spark, sf), "vocab")
    middle = (turns.agg(F.max("turn")).first()[0] + 1) // 2
    for part in (F.col("turn") < middle, F.col("turn") >= middle):
        turns.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(turns.schema).parquet(source)
        running = stream_rolling_context(
            stream, vocab, CHAT_WINDOW, out, is_reset=_system(), eos_roles=("assistant",), block=BLOCK
        )
        running.awaitTermination()
    return _contexts_as_text(spark.read.parquet(f"{out}/contexts"))


@query
def stateful_rolling_context(spark: SparkSession, sf: str) -> DataFrame:
    """The same stream with the state in Spark's own store, the later half after a restart."""
    turns = table(spark, sf, "conversations")
    source, out = new_path(spark, "turns"), new_path(spark, "stream")
    vocab = vocab_of(spark, sf)
    middle = (turns.agg(F.max("turn")).first()[0] + 1) // 2
    for part in (F.col("turn") < middle, F.col("turn") >= middle):
        turns.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(turns.schema).parquet(source)
        keep_rolling_context(stream, vocab, CHAT_WINDOW, out, is_reset=_system(), eos_roles=("assistant",)).awaitTermination()
    return _contexts_as_text(spark.read.parquet(f"{out}/contexts"))


# --- model and generation ----------------------------------------------------------

@query
def fit_next_token_model(spark: SparkSession, sf: str) -> DataFrame:
    """Per context of up to two tokens: its tokens and their counts."""
    model = next_token.fit_next_token_model(windows(spark, sf, MODEL_TOP_K, 2), 2)
    return model.table.groupBy(joined(F.col("ctx")).alias("ctx")).agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum("n").alias("total"), checksum(F.col("token_id"), F.col("n"))
    )


@query
def save_load_model(spark: SparkSession, sf: str) -> DataFrame:
    """The model of ``fit_next_token_model`` from where it was saved."""
    path = new_path(spark, "model")
    next_token.save_model(next_token.fit_next_token_model(windows(spark, sf, MODEL_TOP_K, 2)), path)
    model = next_token.load_model(spark, path)
    per_ctx = model.table.groupBy("ctx").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("n").alias("total"))
    both = per_ctx.join(model.heads, "ctx")
    return both.select(joined(F.col("ctx")).alias("ctx"), "n_tokens", "total", "best", "seen", F.lit(model.order).alias("order"))


@query
def generate_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Two samples per prompt, up to the default length or EOS."""
    rows, vocab = _model_rows(spark, sf, SCORED_TOP_K)
    scorer = generation.model_scorer(next_token.fit_next_token_model(rows))
    prompts = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))
    texts = generation.generate_batch(prompts, vocab, scorer, next_token.ORDER, num_samples=2, sampling="top_k", seed=SEED)
    return texts.select("prompt_id", "sample_idx", "generated")


@query
def generate_by_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy generation with the table of neighbouring tokens as the model."""
    pairs = materialize(scored(spark, sf), "scored")
    vocab = materialize(vocab_of(spark, sf, SCORED_TOP_K), "vocab")

    def scorer(rows: DataFrame, keys) -> DataFrame:
        last = rows.select(*keys, F.element_at("ctx", -1).alias("ctx_id"))
        return last.join(pairs, "ctx_id").select(*keys, "token_id", "p")

    prompts = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))
    return generation.generate_batch(prompts, vocab, scorer, 1, sampling="greedy").select(
        "prompt_id", "sample_idx", "generated"
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent next tokens of the windowed corpus."""
    return top_targets(spark, sf)


__all__ = ["QUERIES", "flagship"]
