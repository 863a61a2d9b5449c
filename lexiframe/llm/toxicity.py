"""Toxicity by weak supervision.

Many voters look at a text: word lists, word-beginning patterns, and how dense their hits
are. A generative model of the votes estimates how often each voter fires on toxic and on
other texts, and how far voters repeat one another, and turns votes into posterior labels.
A linear classifier is trained on these and scores every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.keys import original, present

# Bounds of the sample of labelled rows that voters, label model and classifier are fitted on.
LABELLED_ROWS = 20_000
MAX_VOTERS = 256
# A mined voter fires in at least so many toxic texts, and mostly in toxic ones.
MIN_TOXIC = 4
MIN_PRECISION = 0.75
PATTERN_LENGTHS = (4, 5, 6)
N_GROUPS = 8
# Pattern voters on the number of words that call a voter, and on their number per 100 words.
HITS_VOTES = (2, 3, 5)
DENSE_VOTES = (0.5, 1.0, 3.0)
EM_ROUNDS = 25
# How sure the given label is to begin with.
LABEL_TRUST = 0.9
CACHE_WORDS = 200_000

# Common insults, the lexicon to begin with.
INSULTS = "clown disgusting dumb fool garbage idiot jerk loser moron pathetic scum stupid trash ugly vermin worthless".split()

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_keys(word: str) -> list[str]:
    """The word itself and its beginnings, as lexicon and pattern keys."""
    return [f"={word}", *(f"{word[:n]}*" for n in PATTERN_LENGTHS if len(word) >= n)]


@dataclass
class ToxicityModel:
    """Voters by key, and the weights of the linear classifier over their features."""

    voters: dict[str, int]
    weights: np.ndarray
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None


def n_votes(voters: dict[str, int]) -> int:
    """Voters by key and pattern voters: the first features."""
    return len(voters) + len(HITS_VOTES) + len(DENSE_VOTES)


def n_features(voters: dict[str, int]) -> int:
    """One per voter, one per group of voters by key, hits, hits a word, a constant."""
    return n_votes(voters) + N_GROUPS + 3


class Featurizer:
    """Features of texts; remembers the voters that each word calls."""

    def __init__(self, voters: dict[str, int]):
        self.voters, self.calls = voters, {}

    def votes(self, text: str | None) -> tuple[list[int], int, int]:
        """The voters that fire, the number of words that call any, the number of words."""
        words = words_of(text)
        if len(self.calls) > CACHE_WORDS:
            self.calls.clear()
        fired: set[int] = set()
        hits = 0
        calls, voters = self.calls, self.voters
        for word in words:
            found = calls.get(word)
            if found is None:
                found = calls[word] = tuple(voters[k] for k in word_keys(word) if k in voters)
            if found:
                hits += 1
                fired.update(found)
        return sorted(fired), hits, len(words)

    def features(self, texts: list[str | None]) -> np.ndarray:
        n, all_votes = len(self.voters), n_votes(self.voters)
        out = np.zeros((len(texts), n_features(self.voters)), np.float32)
        for row, text in zip(out, texts):
            fired, hits, words = self.votes(text)
            dense = 100.0 * hits / max(words, 1)
            row[fired] = 1
            row[n:all_votes] = [*(hits >= h for h in HITS_VOTES), *(dense >= d for d in DENSE_VOTES)]
            for v in fired:
                row[all_votes + v % N_GROUPS] = 1
            row[-3] = np.log1p(hits)
            row[-2] = min(10.0, dense) / 10
            row[-1] = 1
        return out


def mine_voters(sample: DataFrame) -> dict[str, int]:
    """Keys that mark toxic texts among the labelled sample ``(text, toxic)``, and the fixed lexicon.

    Counted in Spark as texts per key; a key stays if the smoothed share of toxic texts
    among those that hold it is high. Of keys with the same counts the shorter comes first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                counts[bool(toxic)].update({k for w in set(words_of(text)) for k in word_keys(w)})
        keys = [*counts[True], *(k for k in counts[False] if k not in counts[True])]
        if keys:
            found = {"toxic": [counts[True][k] for k in keys], "other": [counts[False][k] for k in keys]}
            yield pd.DataFrame({"key": np.array(keys, object), **found})

    # A text that is copied many times is one text.
    counted = sample.dropDuplicates(["text"]).mapInPandas(run, "key string, toxic long, other long")
    counted = counted.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    precision = F.col("toxic") / (F.col("toxic") + F.col("other") + 1.0)
    marks = counted.where((F.col("toxic") >= MIN_TOXIC) & (precision >= MIN_PRECISION))
    marks = marks.orderBy(F.desc(F.col("toxic") * precision * precision), F.length("key"), "key").limit(MAX_VOTERS)
    keys = [r["key"] for r in marks.collect()]
    return {k: i for i, k in enumerate(dict.fromkeys([*(f"={w}" for w in INSULTS), *keys]))}


def fit_label_model(votes: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior labels by expectation maximisation over votes and the (noisy) given label.

    Returns the posteriors, the firing rates of each voter by class, and the correlations
    of voters among texts of one class. A voter's evidence is divided by one plus its
    positive correlations, so that voters who repeat each other count once. One more voter
    fires when no other does; the given label speaks both when it is 1 and when it is 0.
    The share of toxic texts stays that of the given labels.
    """
    silent = 1 - votes.max(axis=1, initial=0)
    voted = np.column_stack([votes, silent, given, 1 - given]).astype(np.float32)
    prior = np.log(np.clip(given.mean(), 1e-3, 0.5) / (1 - np.clip(given.mean(), 1e-3, 0.5)))
    posterior = np.where(given > 0, LABEL_TRUST, 1 - LABEL_TRUST)
    rates = correlation = discount = None
    for _ in range(EM_ROUNDS):
        share = np.stack([1 - posterior, posterior]).astype(np.float32)
        rates = (share @ voted + 0.5) / (share.sum(axis=1)[:, None] + 1.0)
        if correlation is None:
            centred = voted - share.T @ rates
            deviation = np.sqrt((centred**2).mean(axis=0)) + 1e-6
            correlation = (centred.T @ centred) / len(voted) / deviation[:, None] / deviation[None, :]
            np.fill_diagonal(correlation, 0)
            discount = 1 / (1 + np.maximum(correlation[:, : votes.shape[1]], 0).sum(axis=1))
            discount[-3:] = 1
        score = prior + voted @ (discount * np.log(rates[1] / rates[0]))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-4:
            break
    return posterior, rates, correlation


def fit_logistic(features: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps."""
    x = features.astype(np.float64)
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - target) + penalty * weights
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        weights -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit_toxicity(labelled: DataFrame, n_rows: int = LABELLED_ROWS) -> ToxicityModel:
    """Fit on at most ``n_rows`` rows of ``labelled(doc_id, text, toxic)``, chosen by a hash of the id.

    Rows with a null text or label are left out. Without any toxic and other rows the fixed lexicon
    votes alone and the score is low for all.
    """
    rows = labelled.where(F.col("toxic").isNotNull() & F.col("text").isNotNull())
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_rows)
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("text", "toxic")
    voters = mine_voters(sample)
    size = n_features(voters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        featurizer = Featurizer(voters)
        for batch in batches:
            found = featurizer.features(list(batch["text"]))
            yield pd.DataFrame(
                {
                    "fired": [np.flatnonzero(r[:-3]).astype(np.int32) for r in found],
                    "hits": found[:, -3].astype(np.float64),
                    "dense": found[:, -2].astype(np.float64),
                    "toxic": batch["toxic"].to_numpy(),
                }
            )

    # At most n_rows short rows: which features fire, two numbers, the label.
    fitted = sample.mapInPandas(run, "fired array<int>, hits double, dense double, toxic int").toPandas()
    given = fitted["toxic"].to_numpy(np.float64)
    if not len(given) or given.min() == given.max():
        return ToxicityModel(voters, np.concatenate([np.zeros(size - 1), [-5.0]]))
    x = np.zeros((len(given), size), np.float32)
    for row, fired in zip(x, fitted["fired"]):
        row[np.asarray(fired, int)] = 1
    x[:, -3], x[:, -2], x[:, -1] = fitted["hits"], fitted["dense"], 1
    order = np.lexsort([*x.T[-3:-1], x[:, : len(voters)].sum(axis=1), given])  # the same sums whatever the partitions
    x, given = x[order], given[order]
    posterior, rates, correlation = fit_label_model(x[:, : n_votes(voters)], given)
    return ToxicityModel(voters, fit_logistic(x, posterior), rates, correlation)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, score)`` of every row of ``docs(doc_id, text)``; the score lies between 0 and 1.

    A null or empty text gets the score of a text without any hit. Null and repeated ids are
    kept; other columns are not read. A narrow step.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        featurizer = Featurizer(model.voters)
        for batch in batches:
            z = np.concatenate(
                [featurizer.features(list(batch["text"][i : i + 1000])) @ model.weights for i in range(0, len(batch), 1000)]
                or [np.zeros(0)]
            )
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    scored = docs.select(present("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
    return scored.withColumn("doc_id", original("doc_id"))
