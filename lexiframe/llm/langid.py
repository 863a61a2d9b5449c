"""Languages of a text by Viterbi decoding over word scores.

A word's score per language is the naive Bayes log-likelihood of its letter n-grams,
learned from labelled texts; languages that are not written in the word's script are out
of the running. Decoding with a penalty per switch labels spans of mixed-language text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.words import release_memory

HASH_BITS = 16
NGRAMS = (2, 3, 4)
SWITCH_PENALTY = 8.0
# A word says at most so much (in nats) against a language.
WORD_LIMIT = 6.0
# A language is written in a script if at least this share of its words is.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
CACHE_WORDS = 150_000
# So many distinct words are cut into n-grams at a time.
CHUNK = 1 << 14
# Texts are decoded together as long as they have at most so many characters; a longer one goes alone.
CHARACTERS = 1 << 21

# First code points of blocks of letters and the script used there.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = tuple(sorted({name for _, name in SCRIPTS}))
_STARTS = np.array([first for first, _ in SCRIPTS])
_SCRIPT_AT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

_WORD = re.compile(r"[^\W\d_]+")
_SIZE = 1 << HASH_BITS
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower()) if text else []


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: the buckets of all n-grams, the word of each, and the script of each word."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = codes == 32
    word_at = np.cumsum(space) - 1
    buckets, owners = [], []
    for n in NGRAMS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        value = np.full(size, n, np.uint64)
        ok = ~space[1 : 1 + size] if n == 2 else np.ones(size, bool)
        ok = ok | ~space[:size]
        for i in range(n):
            value = value + codes[i : i + size].astype(np.uint64) * _PRIMES[i]
            if 0 < i < n - 1:
                ok &= ~space[i : i + size]
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((value >> np.uint64(64 - HASH_BITS)).astype(np.int64)[ok])
        owners.append(word_at[:size][ok])
    first = codes[np.flatnonzero(space)[:-1] + 1]
    scripts = _SCRIPT_AT[np.searchsorted(_STARTS, first, side="right") - 1]
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order], scripts


class LanguageModel:
    """Log-likelihoods of n-gram buckets and the scripts of each language."""

    def __init__(self, languages: list[str], table: np.ndarray, written_in: np.ndarray):
        self.languages, self.table, self.written_in = languages, table, written_in

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Score of each word for each language: 0 for the best, at least -WORD_LIMIT."""
        parts = [self._scores(words[a : a + CHUNK]) for a in range(0, len(words), CHUNK)]
        return np.concatenate(parts)

    def _scores(self, words: list[str]) -> np.ndarray:
        bucket, owner, scripts = word_features(words)
        starts = np.searchsorted(owner, np.arange(len(words)))
        scores = np.add.reduceat(self.table[bucket], starts, axis=0)
        allowed = self.written_in[scripts]
        allowed = allowed | ~allowed.any(axis=1, keepdims=True)
        scores = np.where(allowed, scores, -1e6)
        return np.maximum(scores - scores.max(axis=1, keepdims=True), -WORD_LIMIT).astype(np.float32)


def learn_languages(labelled: DataFrame) -> LanguageModel:
    """Count letter n-grams of all rows of ``labelled(text, lang)``; null texts and labels are left out.

    Tasks count words first, and n-grams of distinct words; the table that leaves them has
    at most 2**HASH_BITS rows per language, however large the corpus.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                counts: Counter = Counter()
                for text in texts:
                    counts.update(words_of(text))
                if not counts:
                    continue
                words = list(counts)
                numbers = np.fromiter(counts.values(), np.float64, len(counts))
                total = totals.setdefault(lang, np.zeros(_SIZE + len(SCRIPT_NAMES)))
                for a in range(0, len(words), CHUNK):
                    bucket, owner, scripts = word_features(words[a : a + CHUNK])
                    n = numbers[a : a + CHUNK]
                    total[:_SIZE] += np.bincount(bucket, weights=n[owner], minlength=_SIZE)
                    total[_SIZE:] += np.bincount(scripts, weights=n, minlength=len(SCRIPT_NAMES))
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "cell": at, "n": total[at].astype(np.int64)})

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counted = rows.mapInPandas(run, "lang string, cell int, n long")
    table = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((_SIZE + len(SCRIPT_NAMES), len(languages)))
    if languages:
        counts[table["cell"], table["lang"].map(languages.index)] = table["n"]
    grams, scripts = counts[:_SIZE], counts[_SIZE:]
    smooth = 0.5
    likelihood = np.log((grams + smooth) / (grams.sum(axis=0) + smooth * _SIZE))
    written_in = scripts / np.maximum(scripts.sum(axis=0), 1) >= SCRIPT_SHARE
    return LanguageModel(languages, likelihood.astype(np.float32), written_in)


def viterbi(scores: np.ndarray, word_at: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best language per word of many texts at once.

    ``word_at`` has the rows of ``scores`` for the words of each text. Step t handles the
    t-th word of every text that has one; ties go to the first language, and to staying.
    """
    kind = np.min_scalar_type(max(scores.shape[1] - 1, 0))
    order = sorted(range(len(word_at)), key=lambda i: -len(word_at[i]))
    sizes = np.array([len(word_at[i]) for i in order])
    steps = int(sizes[0]) if len(sizes) else 0
    if not steps:
        return [np.empty(0, kind) for _ in word_at]
    bases = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.concatenate([word_at[i] for i in order])
    came = np.zeros((len(flat), scores.shape[1]), kind)
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    own = np.arange(scores.shape[1], dtype=kind)
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    for t in range(steps):
        k = active[t]
        v = value[:k]
        if t:
            top = v.argmax(axis=1)
            switched = v[np.arange(k), top][:, None] - np.float32(penalty)
            stay = v >= switched
            came[bases[:k] + t] = np.where(stay, own, top[:, None].astype(kind))
            v = np.maximum(v, switched)
            v = v - v.max(axis=1, keepdims=True)
        value[:k] = v + scores[flat[bases[:k] + t]]
    labels = np.empty(len(flat), kind)
    state = value.argmax(axis=1).astype(kind)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = bases[:k] + t
        labels[at] = state[:k]
        state[:k] = came[at, state[:k]]
    out: list[np.ndarray] = [np.empty(0, kind)] * len(word_at)
    for place, i in enumerate(order):
        out[i] = labels[bases[place] : bases[place] + sizes[place]]
    return out


def slices_of(texts: pd.Series, most: int = CHARACTERS) -> Iterator[pd.Series]:
    """Successive texts with at most ``most`` characters together, or one longer text."""
    start = total = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > start and total + size > most:
            yield texts.iloc[start:i]
            start, total = i, 0
        total += size
    if start < len(texts):
        yield texts.iloc[start:]


def identify_languages(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs(text, ...)`` with ``lang_pred``, ``score`` and ``spans``; other columns stay, but for such of these names.

    ``spans`` has (language, first word, number of words) of each run in one language, over
    the letter runs of the text. ``lang_pred`` is the language with most letters in
    its distinct words (ties: the first in order), ``score`` its share of these letters. A null text, one without letters, or an empty model
    gives ``und``, 0 and no spans. Repeated rows get a result each. A narrow step; a task
    holds one Arrow batch of texts, and decodes ``CHARACTERS`` of it at a time.
    """
    languages = model.languages
    names = np.array(languages, object)

    @F.pandas_udf("lang_pred string, score double, spans array<struct<lang: string, start: int, n: int>>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        scores = np.zeros((0, len(languages)), np.float32)
        letters = np.zeros(0, np.int64)
        for batch in (part for texts in batches for part in slices_of(texts)):
            if len(known) > CACHE_WORDS:
                known.clear()
                scores, letters = scores[:0], letters[:0]
            before = len(known)
            texts = []
            for text in batch:
                words = words_of(text) if languages else []
                texts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            new = list(known)[before:]
            if new:
                scores = np.concatenate([scores, model.word_scores(new)])
                letters = np.concatenate([letters, np.fromiter(map(len, new), np.int64, len(new))])
            preds, shares, spans = [], [], []
            for at, label in zip(texts, viterbi(scores, texts, penalty)):
                if not len(at):
                    preds.append(UNKNOWN), shares.append(0.0), spans.append([])
                    continue
                # A word said over and over counts once.
                once = np.unique(at.astype(np.int64) * len(languages) + label)
                weight = np.bincount(once % len(languages), weights=letters[once // len(languages)], minlength=len(languages))
                preds.append(languages[int(weight.argmax())])
                shares.append(float(weight.max() / weight.sum()))
                first = np.concatenate([[0], np.flatnonzero(label[1:] != label[:-1]) + 1])
                size = np.diff(np.concatenate([first, [len(label)]]))
                spans.append([{"lang": l, "start": int(s), "n": int(n)} for l, s, n in zip(names[label[first]], first, size)])
            yield pd.DataFrame({"lang_pred": preds, "score": shares, "spans": spans})
        known.clear()
        release_memory()

    made = ("lang_pred", "score", "spans")
    found = "_lang" + "_" * max(map(len, docs.columns))  # no column has this name
    return docs.withColumn(found, decode.asNondeterministic()("text")).select(
        *[F.col(c) for c in docs.columns if c not in made], *[F.col(f"{found}.{c}").alias(c) for c in made]
    )
