"""Repetition coverage: how much of a text lies inside duplicated word runs and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lexiframe.llm.keys import original, present
from lexiframe.llm.words import BASES, Powers, Rolling, WordHashes, covered

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 8
BASE_MIN_WORDS = 20
BASE_MAX_REPEATED = 0.30

# Largest share of a text's word characters inside duplicated runs of so many words.
RUN_LIMITS = {5: 0.40, 8: 0.30, 13: 0.25, 20: 0.20}
# Largest share inside lines that repeat an earlier line.
LINE_LIMIT = 0.30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " coverage map<int, double>, dup_line_share double, base_failed boolean, kept boolean"
)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True


def _word_lengths(data: bytes) -> np.ndarray:
    """Code points of every word."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_IS_WHITE[raw]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[np.flatnonzero(edges == -1)] - points[np.flatnonzero(edges == 1)]


def _repeated(rolling: Rolling, k: int, n: int) -> np.ndarray:
    """The words in runs of ``k`` words found twice or more, the first included."""
    runs = rolling.runs(k)
    if not len(runs):
        return np.zeros(n, bool)
    _, place, count = np.unique(runs, return_inverse=True, return_counts=True)
    return covered(np.flatnonzero(count[place] > 1), k, n)


def measure(text: str | None, hashes: WordHashes, powers: Powers) -> tuple:
    """The measures of one text, in the order of SCHEMA without the id."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    lengths = _word_lengths(data)
    chars = int(lengths.sum())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen, dup_lines, dup_chars = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                dup_lines += 1
                dup_chars += int(_word_lengths(line).sum())
            seen.add(line)
    rolling = Rolling(hashes.of(words), powers)
    inside = {k: _repeated(rolling, k, n) for k in sorted({BASE_WINDOW, *RUN_LIMITS})}
    repeat_words = int(inside[BASE_WINDOW].sum())
    coverage = {k: float(lengths[inside[k]].sum()) / max(chars, 1) for k in RUN_LIMITS}
    line_share = dup_chars / max(chars, 1)
    base_failed = n < BASE_MIN_WORDS or 100 * repeat_words > round(100 * BASE_MAX_REPEATED) * n
    kept = not base_failed and line_share <= LINE_LIMIT and all(coverage[k] <= most for k, most in RUN_LIMITS.items())
    return n, chars, symbols, dup_lines, repeat_words, coverage, line_share, base_failed, kept


def repetition_quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with its repetition measures and verdict.

    Words are runs of characters other than the six ASCII white spaces. A null or empty
    text has no words and fails the base rule; a null ``doc_id`` stays null; repeated rows
    are measured each; other columns are not read. A narrow step: nothing is shuffled, and
    a task holds one text and its rolling hashes at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, powers = WordHashes(), Powers(BASES[0])
        names = [f.split()[0] for f in SCHEMA.replace("map<int, double>", "map").split(", ")]
        for batch in batches:
            rows = [(d, *measure(t, hashes, powers)) for d, t in zip(batch["doc_id"], batch["text"])]
            out = pd.DataFrame(rows, columns=names)
            yield out

    measured = docs.select(present("doc_id"), "text").mapInPandas(run, SCHEMA)
    return measured.withColumn("doc_id", original("doc_id"))
