"""Benchmark items inside documents, by a prefix-filtered containment join.

Every window of an item must be contained whole, so with its shingles in one global order
from rare to frequent, the first (rarest) one is its necessary prefix: a document that
holds the window holds that shingle. Documents are joined with these prefixes only;
the place of the shingle gives the place of the window, lengths and bounds are checked, and the
words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.keys import original, present
from lexiframe.llm.words import BASES, LOWER_ASCII, Powers, Rolling, WordHashes, signed
from lexiframe.session import materialize

WINDOW = 10
SHINGLE = 3
# The filter on shingle hashes has a fixed size: 2**BITS bits.
BITS = 22

# ASCII letters and digits stay, bytes of longer characters too; the rest parts words.
_KEEP = bytes(
    b if (chr(b).isalnum() and b < 128) or b >= 128 else 32 for b in LOWER_ASCII
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``(item_id, words, size, shingles)`` of every distinct window of ``items(item_id, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, powers = WordHashes(), Powers(BASES[0])
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                words = words_of(text)
                size = min(window, len(words))
                if not size:
                    continue
                k = min(SHINGLE, size)
                shingles = signed(Rolling(hashes.of(words), powers).runs(k))
                decoded = [w.decode("utf-8", "replace") for w in words]
                for i in range(len(words) - size + 1):
                    rows.append((item, decoded[i : i + size], size, k, shingles[i : i + size - k + 1]))
            yield pd.DataFrame(rows, columns=["item_id", "words", "size", "k", "shingles"])

    schema = "item_id string, words array<string>, size int, k int, shingles array<long>"
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(run, schema)
    return rows.dropDuplicates(["item_id", "words"])


def _bit(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BITS)


def _filter_of(spark, shingles: DataFrame):
    """A broadcast bitmap of at most 2**BITS bits that knows all given shingles."""
    at = [r["at"] for r in shingles.select(_bit(F.col("shingle")).alias("at")).distinct().collect()]
    bits = np.zeros(1 << BITS, bool)
    bits[at] = True
    return spark.sparkContext.broadcast(np.packbits(bits))


def _known(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    at = hashed >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, _text, n_words, hits, item_ids``.

    ``hits`` lists (start, size) of all occurrences of windows of ``items(item_id, text)``,
    ``item_ids`` the items they come from, as sorted strings. Null or empty texts have
    no words and no hits; an item without words is never found; items with equal texts are all found; an item with a null id is
    found by its words but has no name. Rows that share a doc_id are told apart by their text (``_text`` is its hash).

    The text is read twice and never shuffled: once to count the items' shingles, which
    orders them by rarity, and once to look for the rarest shingle of each window. What is
    broadcast is a bitmap of fixed size; exact matching is a join.
    """
    spark = docs.sparkSession
    docs = docs.select(present("doc_id"), "text")
    windows = materialize(item_windows(items, window), "windows")
    shingles = windows.select("k", F.explode("shingles").alias("shingle")).distinct()
    sizes = sorted(r["k"] for r in shingles.select("k").distinct().collect())
    known = _filter_of(spark, shingles)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, powers = WordHashes(), Powers(BASES[0])
        bits = known.value
        for batch in batches:
            found = []
            for text in batch["text"]:
                rolling = Rolling(hashes.of(words_of(text)), powers)
                for k in sizes:
                    runs = rolling.runs(k)
                    found.append(runs[_known(bits, runs)])
            values, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"shingle": signed(values), "n": n})

    counts = docs.select("text").mapInPandas(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    # The rarest shingle of each window; ties by hash.
    at = windows.select("words", "size", "k", F.posexplode("shingles").alias("offset", "shingle")).distinct()
    rare = at.join(counts, "shingle").groupBy("words", "size", "k")
    rare = rare.agg(F.min(F.struct("n", "shingle", "offset")).alias("first"))
    prefixes = materialize(rare.select("words", "size", "k", "first.shingle", "first.offset"), "prefixes")
    wanted = _filter_of(spark, prefixes)
    reach = window

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, powers = WordHashes(), Powers(BASES[0])
        bits = wanted.value
        for batch in batches:
            n_words, hits = [], []
            for text in batch["text"]:
                words = words_of(text)
                rolling = Rolling(hashes.of(words), powers)
                n_words.append(len(words))
                found = []
                for k in sizes:
                    runs = rolling.runs(k)
                    for p in np.flatnonzero(_known(bits, runs)):
                        first = max(0, int(p) - reach + 1)
                        around = words[p : p + k] if k < SHINGLE else words[first : p + reach]
                        found.append(
                            {
                                "k": k,
                                "shingle": int(runs[p : p + 1].view(np.int64)[0]),
                                "pos": int(p),
                                "first": int(p) if k < SHINGLE else first,
                                "around": [w.decode("utf-8", "replace") for w in around],
                            }
                        )
                hits.append(found)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "_text": batch["_text"], "n_words": n_words, "hits": hits})

    schema = (
        "doc_id long, _text long, n_words long,"
        " hits array<struct<k: int, shingle: long, pos: int, first: int, around: array<string>>>"
    )
    keyed = docs.withColumn("_text", F.xxhash64("text"))
    seen = materialize(keyed.mapInPandas(look, schema), "seen")
    hits = seen.select("doc_id", "_text", F.explode("hits").alias("hit")).select("doc_id", "_text", "hit.*")
    start = F.col("pos") - F.col("offset")
    begin = start - F.col("first")
    matched = (
        hits.join(prefixes, ["k", "shingle"])
        # Length and position: the window must lie inside what was seen of the text.
        .where((begin >= 0) & (begin + F.col("size") <= F.size("around")))
        .where(F.slice("around", begin + 1, F.col("size")) == F.col("words"))
        .select("doc_id", "_text", start.alias("start"), "size", "words")
        .distinct()
    )
    matched = materialize(matched, "matched")
    spans = matched.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("start", "size")).alias("hits"))
    named = (
        matched.select("doc_id", "_text", "words")
        .distinct()
        .join(windows.select("words", "item_id"), "words")
        .groupBy("doc_id", "_text")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    return (
        seen.select("doc_id", "_text", "n_words")
        .join(spans, ["doc_id", "_text"], "left")
        .join(named, ["doc_id", "_text"], "left")
        .select(
            original("doc_id"),
            "_text",
            "n_words",
            F.coalesce("hits", F.array().cast("array<struct<start:int,size:int>>")).alias("hits"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )


def hit_words(hits: Column) -> Column:
    """The number of words inside any of the (start, size) runs."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, hit: Column) -> Column:
        end = F.greatest(acc["end"], hit["start"] + hit["size"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], F.least(hit["start"], end))).alias("n"), end.alias("end"))

    return F.aggregate(F.array_sort(hits), zero, step, lambda acc: acc["n"].cast("long"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window of ``items``, all columns kept.

    Null texts stay. One shuffle join on the id and text hash of contaminated rows.
    """
    found = find_items(docs, items, window).where(F.size("hits") > 0).select("doc_id", "_text").distinct()
    left, right = docs.alias("d"), found.alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f._text"))
    return left.join(right, same, "left_anti")
