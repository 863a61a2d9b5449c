"""The three jobs of the workflow, each from files to files.

Corpus -> vocabulary, corpus and vocabulary -> training rows, training rows -> model
and report. Every job cuts lineage where a result is read more than once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.operators import dataset, encoding, generation, next_token, splitting, vocabulary
from lexiframe.session import materialize
from lexiframe.sources import artifacts, corpus


def build_vocabulary(
    docs: DataFrame,
    path: str,
    min_freq: int = vocabulary.MIN_FREQ,
    top_k: int | None = vocabulary.TOP_K,
    lowercase: bool = True,
    coverage_percent: float | None = None,
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Write the tokenizer and ``stats`` below ``path``; return the vocabulary.

    With ``coverage_percent`` the vocabulary is cut by coverage instead of by
    ``min_freq`` and ``top_k``. The text is counted once.
    """
    counts = materialize(vocabulary.count_vocab(docs, "text", lowercase, tokenizer), "counts")
    if coverage_percent is not None:
        vocab = vocabulary.coverage_vocab(counts, coverage_percent)
        stats = vocabulary.coverage_stats(counts, coverage_percent)
    else:
        vocab = vocabulary.assign_ids(counts, min_freq, top_k)
        stats = vocabulary.build_stats(
            docs, min_freq, top_k, counts=counts, lowercase=lowercase, tokenizer=tokenizer
        )
    options = artifacts.TokenizerOptions(lowercase=lowercase)
    artifacts.write_tokenizer(materialize(vocab, "vocab"), path, options)
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return artifacts.read_vocab(docs.sparkSession, f"{path}/vocab")


def make_dataset(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    context_length: int = dataset.CONTEXT_LENGTH,
    max_samples: int | None = None,
    shuffle: bool = True,
    seed: int = dataset.SEED,
    val_ratio: float | None = None,
    tokenizer: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Write training rows, metadata and ``stats`` below ``path``; return the rows.

    A vocabulary built with a tokenizer of one's own needs the same one here.
    """
    spark = docs.sparkSession
    vocab, options = artifacts.read_tokenizer(spark, tokenizer_path)
    encoded = materialize(encoding.encode(docs, vocab, add_bos_eos=True, lowercase=options.lowercase, tokenizer=tokenizer), "encoded")
    rows = dataset.context_windows(encoded, context_length)
    rows = dataset.limit_samples(rows, max_samples, shuffle, seed)
    if val_ratio is not None:
        rows = splitting.train_val_split(materialize(rows, "samples"), val_ratio, seed)
    artifacts.write_dataset(dataset.shuffle_rows(rows, seed) if shuffle else rows, path)
    stored = artifacts.read_dataset(spark, path)
    stats = dataset.dataset_stats(stored, vocab, docs, max_samples=max_samples, shuffle=shuffle, seed=seed)
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")
    return stored


def train_model(
    rows: DataFrame,
    vocab: DataFrame,
    path: str,
    order: int = next_token.ORDER,
    valid_size: float = splitting.VALID_SIZE,
    seed: int = dataset.SEED,
    shuffle: bool = True,
) -> tuple[next_token.NextTokenModel, DataFrame]:
    """Stratified split, counts of the training rows; write model and report below ``path``."""
    spark = rows.sparkSession
    size = vocab.count()
    rows = materialize(rows.select("doc_id", "pos", "ctx", "y"), "rows")
    split = materialize(splitting.stratified_split(rows, valid_size, seed, shuffle), "split")
    model = next_token.fit_next_token_model(split.where(F.col("split") == "train"), order)
    next_token.save_model(model, f"{path}/model")
    report = next_token.model_report(split, model, size, order=order, num_classes=size)
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    return next_token.load_model(spark, f"{path}/model"), spark.read.json(f"{path}/report")


def generate_texts(
    spark: SparkSession, prompts_path: str, vocab: DataFrame, scorer: generation.Scorer, context_length: int, path: str, **settings
) -> DataFrame:
    """Continue every prompt of a file; write the texts with the settings."""
    prompts = artifacts.read_prompts(spark, prompts_path).select("prompt_id", "prompt")
    texts = materialize(generation.generate_batch(prompts, vocab, scorer, context_length, **settings), "texts")
    artifacts.write_generations(texts, path, **settings)
    return texts


def load_corpus(spark: SparkSession, path: str, **options) -> DataFrame:
    """Documents of a corpus file, read by as many tasks as there are cores."""
    return corpus.spread(materialize(corpus.read_corpus(spark, path, **options), "corpus"), "doc_id")
