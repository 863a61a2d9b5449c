"""Flat files of token IDs with 64-bit document offsets, and their reading back.

One file pair per range partition of ``doc_id``: ``ids-00007.bin`` holds the IDs of its
documents one after the other as unsigned integers of 16 bits, or 32 where the vocabulary
needs them; ``offsets-00007.bin`` holds, as unsigned 64-bit integers, the place of every
document in the whole corpus and, last, the place after the last one. ``shards`` (Parquet)
holds one row per pair with the bases.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiframe.llm.bpe import load
from lexiframe.llm.keys import original, present
from lexiframe.llm.tokens import WordEncoder, default_path

END_ID = 2


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``folder``, which driver and executors share, and the path in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _write(files: fs.FileSystem, path: str, chunks: Iterator[bytes]) -> None:
    """Write under a name of this attempt's own, then move: a repeated task harms nothing."""
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(own, path)


def _ids_name(folder: str, shard: int) -> str:
    return f"{folder}/ids-{shard:05d}.bin"


def _offsets_name(folder: str, shard: int) -> str:
    return f"{folder}/offsets-{shard:05d}.bin"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)``, write the files below ``folder``, return ``(shard, n_docs, n_tokens, base)``.

    Documents are range-partitioned by ``doc_id`` (one shuffle of the text); each task
    streams its IDs to one file. The base of a file is the prefix sum of the sizes before
    it, over one row per file; a second step writes the offsets. A null text is empty and
    gets the end ID alone; a null ``doc_id`` sorts last; rows with equal ``doc_id`` are
    ordered by text; no rows give no files. The order in a file is a total one, so a task
    repeated after a loss writes the same bytes. IDs take 2 bytes, or 4 where the
    vocabulary or ``end_id`` is larger than 65,536; ``parts`` says how many.
    """
    path = tokenizer_path or default_path()
    width = 2 if max(len(load(path).strings), end_id + 1) <= 2**16 else 4
    files, _ = _open(folder)
    files.create_dir(_open(folder)[1])
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = docs.select(present("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        files, root = _open(folder)
        encoder = WordEncoder(path)
        end = np.array([end_id], "<u4").tobytes()
        ids, sizes = [], []
        total = 0

        def chunks() -> Iterator[bytes]:
            for batch in batches:
                ids.append(batch.column(0))
                for found in encoder.encode_all(text.as_py() for text in batch.column(1)):
                    data = np.frombuffer(found + end, "<u4")
                    sizes.append(len(data))
                    yield data.astype(f"<u{width}").tobytes()

        _write(files, _ids_name(root, shard), chunks())
        if not sizes:
            files.delete_file(_ids_name(root, shard))
            return
        total = sum(sizes)
        keys = pa.concat_arrays(ids)
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "width": pa.array([width], pa.int32()),
                "n_docs": pa.array([len(sizes)], pa.int64()),
                "n_tokens": pa.array([total], pa.int64()),
                "doc_ids": pa.array([keys.to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
            }
        )

    parts = f"{folder}/parts"
    placed.mapInArrow(
        encode, "shard int, width int, n_docs long, n_tokens long, doc_ids array<long>, sizes array<long>"
    ).write.parquet(parts)
    parts = spark.read.parquet(parts)
    # One row per file: this window stays small.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.select("shard", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    bases.write.parquet(f"{folder}/shards")
    bases = spark.read.parquet(f"{folder}/shards")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum([0, *row["sizes"]], dtype=np.uint64) + np.uint64(row["base"])
                _write(files, _offsets_name(root, row["shard"]), iter([ends.astype("<u8").tobytes()]))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]], pa.int32())})

    offset_rows = parts.join(bases.select("shard", "base"), "shard")
    offset_rows.mapInArrow(offsets, "shard int").write.parquet(f"{folder}/written")
    return bases


def _read(files: fs.FileSystem, path: str, dtype: str, count: int) -> np.ndarray:
    """Memory-mapped where the file system is a mounted one."""
    if isinstance(files, fs.LocalFileSystem) and count:
        return np.memmap(path, dtype, "r", shape=(count,))
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files.

    One task per group of files; a file is mapped, not read into memory.
    """
    parts = spark.read.parquet(f"{folder}/parts").select("shard", "width", "n_docs", "n_tokens", "doc_ids")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _open(folder)
        for batch in batches:
            for row in batch.itertuples():
                offsets = np.asarray(_read(files, _offsets_name(root, row.shard), "<u8", row.n_docs + 1))
                ids = _read(files, _ids_name(root, row.shard), f"<u{row.width}", row.n_tokens)
                local = (offsets - offsets[0]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(local[:-1], local[1:])]
                out = pd.DataFrame({"start": offsets[:-1].astype(np.int64), "n_tokens": np.diff(local), "ids_crc32": crc})
                out.insert(0, "doc_id", row.doc_ids)
                yield out

    found = parts.repartition(max(2, spark.sparkContext.defaultParallelism * 4), "shard").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return found.withColumn("doc_id", original("doc_id"))
