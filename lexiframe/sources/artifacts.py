"""Vocabularies, tokenizer settings, datasets, prompts and generations on disk."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.functions.ids import BOS, EOS, PAD, SPECIAL_TOKENS, UNK
from lexiframe.functions.text import strip
from lexiframe.operators.dataset import dataset_metadata
from lexiframe.operators.vocabulary import special_rows
from lexiframe.sources.corpus import numbered_lines

VOCAB_SCHEMA = "id int, token string, count bigint"


@dataclass(frozen=True)
class TokenizerOptions:
    """Settings that go with a vocabulary."""

    pad_id: int = PAD
    unk_id: int = UNK
    bos_id: int = BOS
    eos_id: int = EOS
    lowercase: bool = True


def write_vocab(vocab: DataFrame, path: str) -> None:
    """The vocabulary as Parquet; frequencies are those of kept tokens only."""
    vocab.select("id", "token", "count").write.mode("overwrite").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCAB_SCHEMA).parquet(path)


def import_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary from JSON: a list of tokens, or an object with ``tokens`` and ``frequencies``."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "array<string>")
    record = F.from_json("value", "tokens array<string>, frequencies map<string,bigint>")
    kind = whole.select(F.substring(strip(F.col("value")), 1, 1).alias("k")).first()["k"]
    if kind == "[":
        parsed = whole.select(listed.alias("tokens"), F.lit(None).cast("map<string,bigint>").alias("freq"))
    elif kind == "{":
        parsed = whole.select(record.alias("r")).select(
            F.coalesce("r.tokens", F.array().cast("array<string>")).alias("tokens"), F.col("r.frequencies").alias("freq")
        )
    else:
        raise ValueError(f"neither a list nor an object of tokens in {path}")
    words = parsed.select(F.posexplode("tokens").alias("_pos", "token"))
    words = words.select((F.col("_pos") + len(SPECIAL_TOKENS)).cast("int").alias("id"), "token")
    counts = parsed.where(F.col("freq").isNotNull()).select(F.explode("freq").alias("token", "count"))
    return special_rows(spark).unionByName(words.join(counts, "token", "left").select("id", "token", "count"))


def check_vocab(vocab: DataFrame) -> None:
    """An error unless IDs run from 0 without gap and no ID or token occurs twice."""
    facts = vocab.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("id").alias("ids"),
        F.countDistinct("token").alias("tokens"),
        F.min("id").alias("lowest"),
        F.max("id").alias("highest"),
    ).first()
    n = facts["n"]
    if n == 0 or (facts["ids"], facts["tokens"], facts["lowest"], facts["highest"]) != (n, n, 0, n - 1):
        raise ValueError(f"vocabulary IDs are not dense and unique: {facts.asDict()}")


def write_tokenizer(vocab: DataFrame, path: str, options: TokenizerOptions = TokenizerOptions()) -> None:
    check_vocab(vocab)
    write_vocab(vocab, f"{path}/vocab")
    spark = vocab.sparkSession
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in asdict(options).items()])
    row.coalesce(1).write.mode("overwrite").json(f"{path}/options")


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, TokenizerOptions]:
    """The vocabulary and its settings; settings not stored take their defaults."""
    schema = "pad_id int, unk_id int, bos_id int, eos_id int, lowercase boolean"
    row = spark.read.schema(schema).json(f"{path}/options").first()
    stored = {k: v for k, v in (row.asDict() if row else {}).items() if v is not None}
    return read_vocab(spark, f"{path}/vocab"), TokenizerOptions(**stored)


OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
SPLITS = 8


def write_dataset(rows: DataFrame, path: str) -> None:
    """Training rows, one folder per ``split`` when they have one, and their metadata."""
    spark = rows.sparkSession
    writer = rows.write.mode("overwrite")
    if "split" in rows.columns:
        # A task keeps a file open for each split; else it would sort, and spill, its rows by split first.
        former = spark.conf.get(OPEN_FILES)
        spark.conf.set(OPEN_FILES, max(int(former), SPLITS))
        try:
            writer.partitionBy("split").parquet(f"{path}/rows")
        finally:
            spark.conf.set(OPEN_FILES, former)
    else:
        writer.parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    dataset_metadata(stored).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    return rows if split is None else rows.where(F.col("split") == split)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_id, prompt): stripped lines that are not empty."""
    lines = numbered_lines(spark, path).withColumn("prompt", strip(F.col("value")))
    return lines.where(F.length("prompt") > 0).select(F.col("line_no").alias("prompt_id"), "prompt", "file")


def write_generations(generations: DataFrame, path: str, as_text: bool = False, **settings) -> None:
    """(prompt, sample_idx, generated) as JSON lines with the settings, or as plain text."""
    if as_text:
        block = F.concat_ws(
            "\n",
            F.concat(F.lit("Prompt: "), "prompt"),
            F.concat(F.lit("Sample: "), F.col("sample_idx").cast("string")),
            F.concat(F.lit("Generated: "), "generated"),
            F.lit(""),
        )
        generations.select(block.alias("value")).write.mode("overwrite").text(path)
        return
    columns = [F.lit(v).alias(k) for k, v in settings.items()]
    generations.select("prompt", "sample_idx", "generated", *columns).write.mode("overwrite").json(path)
